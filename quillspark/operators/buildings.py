"""Buildings (IFC) as relations: arguments split natively, links by place of argument, storeys by pointer doubling, nested properties, materials.

entities(file, id, type, args) are the instances of ISO-10303-21 files. `parsed` splits the arguments once; the other
operators join what it gives. Where a map of the format is set twice, the later instance (by id) counts, but the first for wholes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import graphs

#: A quoted text (a quote inside is doubled), a sign that nests or parts, anything else.
_TOKEN = r"'(?:[^']|'')*'|[(),]|[^'(),]+"


def arguments(args: Column) -> Column:
    """The arguments of an instance, cut at the commas that stand in no list and no text, trimmed."""
    tokens = F.regexp_extract_all(args, F.lit(_TOKEN), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("at"), F.lit(1).alias("from"), F.array().cast("array<struct<a:int,n:int>>").alias("cut"))

    def step(acc: Column, t: Column) -> Column:
        here = acc["at"] + F.length(t)
        ends = (t == ",") & (acc["depth"] == 0)
        cut = F.when(ends, F.concat(acc["cut"], F.array(F.struct(acc["from"].alias("a"), (acc["at"] - acc["from"]).alias("n"))))).otherwise(acc["cut"])
        depth = acc["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), here.alias("at"), F.when(ends, here).otherwise(acc["from"]).alias("from"), cut.alias("cut"))

    spans = F.aggregate(tokens, start, step, lambda acc: F.concat(acc["cut"], F.array(F.struct(acc["from"].alias("a"), (acc["at"] - acc["from"]).alias("n")))))
    return F.when(F.trim(args) == "", F.array().cast("array<string>")).otherwise(F.transform(spans, lambda s: F.trim(F.substring(args, s["a"], s["n"]))))


def listed(arg: Column) -> Column:
    """The members of a list argument; null where it is no list."""
    return F.when(F.startswith(arg, F.lit("(")) & F.endswith(arg, F.lit(")")), arguments(F.substring(arg, F.lit(2), F.length(arg) - 2)))


def reference(arg: Column) -> Column:
    """The instance that an argument refers to, else null."""
    return F.regexp_extract(arg, r"^#(\d+)$", 1).try_cast("bigint")


def references(arg: Column) -> Column:
    """The instances of a list argument, in order."""
    return F.filter(F.transform(F.coalesce(listed(arg), F.array().cast("array<string>")), reference), lambda r: r.isNotNull())


def _decoded(text: Column) -> Column:
    """Escapes of texts: doubled quotes, and characters in hexadecimal (two, four or eight digits each)."""
    parts = F.regexp_extract_all(text, F.lit(r"\\X2\\[0-9A-Fa-f]*\\X0\\|\\X4\\[0-9A-Fa-f]*\\X0\\|\\X\\[0-9A-Fa-f]{2}|\\|[^\\]+"), F.lit(0))
    hexed = lambda p, a, b: F.unhex(F.substring(p, F.lit(a), F.length(p) - b))
    each = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("\\X2\\")), F.decode(hexed(p, 5, 8), "UTF-16BE")).when(F.startswith(p, F.lit("\\X4\\")), F.decode(hexed(p, 5, 8), "UTF-32")).when(F.startswith(p, F.lit("\\X\\")), F.decode(hexed(p, 4, 3), "ISO-8859-1")).otherwise(p))
    return F.array_join(each, "")


def text_of(arg: Column) -> Column:
    """The text of a quoted argument, else null."""
    inner = F.replace(F.substring(arg, F.lit(2), F.length(arg) - 2), F.lit("''"), F.lit("'"))
    return F.when(arg.rlike(r"^'[\s\S]*'$"), F.when(F.contains(inner, F.lit("\\X")), _decoded(inner)).otherwise(inner))


def _scalar(arg: Column) -> Column:
    bare = F.when(arg.rlike(r"^[A-Z][A-Z0-9_]*\([\s\S]*\)$"), F.trim(F.regexp_extract(arg, r"^[A-Z][A-Z0-9_]*\(([\s\S]*)\)$", 1))).otherwise(arg)
    number = F.round(bare.try_cast("double"), 6).try_cast("decimal(32,6)").cast("string")
    short = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    known = F.when(bare == ".T.", "TRUE").when(bare == ".F.", "FALSE").when(bare == ".U.", "UNKNOWN")
    return F.coalesce(
        F.when(bare.isin("$", "*"), ""), text_of(bare), known, F.when(bare.rlike(r"^\.[A-Z0-9_]+\.$"), F.substring(bare, F.lit(2), F.length(bare) - 2)), F.when(bare.rlike(r"^[-+]?[0-9]"), short), bare
    )


def value_of(arg: Column) -> Column:
    """The text of any value: typed values by what they hold, lists by comma and blank, numbers to six places."""
    inner = F.when(arg.rlike(r"^[A-Z][A-Z0-9_]*\(\s*\("), F.trim(F.regexp_extract(arg, r"^[A-Z][A-Z0-9_]*\(([\s\S]*)\)$", 1))).otherwise(arg)
    return F.coalesce(F.when(F.startswith(inner, F.lit("(")), F.array_join(F.transform(listed(inner), _scalar), ", ")), _scalar(inner), F.lit(""))


def parsed(entities: DataFrame) -> DataFrame:
    """file, id, type, a (the arguments) of all instances, written once."""
    return tables.written(entities.select("file", "id", F.upper("type").alias("type"), arguments(F.coalesce("args", F.lit(""))).alias("a")), "instances")


def _arg(i: int) -> Column:
    return F.get("a", F.lit(i))


#: Fixed values of the format: relation, instance, places of the many and of the one among its arguments.
LINKS = (
    ("contained_in", ("IFCRELCONTAINEDINSPATIALSTRUCTURE",), 4, 5), ("part_of", ("IFCRELAGGREGATES", "IFCRELNESTS"), 5, 4), ("typed_by", ("IFCRELDEFINESBYTYPE",), 4, 5),
    ("made_of", ("IFCRELASSOCIATESMATERIAL",), 4, 5), ("has_properties", ("IFCRELDEFINESBYPROPERTIES",), 4, 5), ("voids", ("IFCRELVOIDSELEMENT",), 5, 4),
)
#: Fixed values of the format: places other than storeys that stand for a level where there is no storey.
LEVELS = (
    "IFCBRIDGE", "IFCBRIDGEPART", "IFCROAD", "IFCROADPART", "IFCRAILWAY", "IFCRAILWAYPART", "IFCFACILITY", "IFCFACILITYPART", "IFCFACILITYPARTCOMMON", "IFCMARINEFACILITY", "IFCMARINEPART",
    "IFCTUNNEL", "IFCTUNNELPART", "IFCEXTERNALSPATIALELEMENT",
)
#: Links that are followed upwards from an element, at most.
STEPS = 29


def links(instances: DataFrame) -> DataFrame:
    """file, relation, child, parent, rel (the instance that says so): every link of every relation."""
    out = None
    for name, kinds, many, one in LINKS:
        children = F.when(F.startswith(_arg(many), F.lit("(")), references(_arg(many))).otherwise(F.filter(F.array(reference(_arg(many))), lambda r: r.isNotNull()))
        part = instances.where(F.col("type").isin(*kinds)).select("file", F.lit(name).alias("relation"), F.explode(children).alias("child"), reference(_arg(one)).alias("parent"), F.col("id").alias("rel")).where("parent is not null")
        out = part if out is None else out.union(part)
    return out


def one_of_each(found: DataFrame, relation: str) -> DataFrame:
    """file, child, parent: of a relation that an element has once, the link that counts."""
    of = F.min_by if relation == "part_of" else F.max_by
    return found.where(F.col("relation") == relation).groupBy("file", "child").agg(of("parent", "rel").alias("parent"))


def storeys(instances: DataFrame, found: DataFrame) -> DataFrame:
    """file, id, storey, storey_name of each element that stands somewhere.

    A storey is its own. Others go up, by what contains them or else by what they are part of, to the first storey, else
    to the first other level; project, site, building and space are none. Both ways are chains that end at the first such
    place, followed by pointer doubling; circles end nowhere.
    """
    inside, part = one_of_each(found, "contained_in"), one_of_each(found, "part_of").withColumnRenamed("parent", "whole")
    up = inside.join(part, ["file", "child"], "full").select("file", F.col("child").alias("id"), F.coalesce("parent", "whole").alias("parent"))
    kinds = instances.where((F.col("type") == "IFCBUILDINGSTOREY") | F.col("type").isin(*LEVELS)).select("file", "id", (F.col("type") == "IFCBUILDINGSTOREY").alias("is_storey"), F.coalesce(F.nullif(text_of(_arg(2)), F.lit("")), text_of(_arg(7))).alias("name"))
    every = up.select("file", "id").union(up.select("file", "parent")).union(kinds.select("file", "id")).distinct()
    nodes = tables.written(every.join(up, ["file", "id"], "left").join(kinds, ["file", "id"], "left"), "places")
    key = lambda c: F.struct("file", F.col(c).alias("id"))
    to_storey = nodes.select(key("id").alias("node"), F.when(F.col("parent").isNotNull() & ~F.coalesce("is_storey", F.lit(False)), key("parent")).alias("following"))
    # The chain to a level starts behind the element itself: its first link is taken before any place may end it.
    level = nodes.select(key("id").alias("node"), F.when(F.col("parent").isNotNull() & F.col("is_storey").isNull(), key("parent")).alias("following"))
    named = nodes.where("is_storey is not null").select("file", F.col("id").alias("place"), "is_storey", "name")
    reach = lambda chain: graphs.ranks_to_end(chain).where(F.col("hops") <= STEPS).select("node", F.col("end.file").alias("file"), F.col("end.id").alias("place"), "hops")
    first = reach(to_storey).join(named.where("is_storey"), ["file", "place"]).select("file", F.col("node.id").alias("id"), F.col("place").alias("storey"), F.col("name").alias("storey_name"))
    above = reach(level).select(F.col("node.id").alias("parent"), "file", "place", "hops").where(F.col("hops") < STEPS)
    second = nodes.where("parent is not null").select("file", "id", "parent").join(above, ["file", "parent"]).join(named.where("not is_storey"), ["file", "place"]).select("file", "id", F.col("place").alias("other"), F.col("name").alias("other_name"))
    both = first.join(second, ["file", "id"], "full")
    return both.select("file", "id", F.coalesce("storey", "other").alias("storey"), F.when(F.col("storey").isNotNull(), F.col("storey_name")).otherwise(F.col("other_name")).alias("storey_name"))




def property_values(instances: DataFrame, found: DataFrame, deepest: int = 3) -> DataFrame:
    """file, element, key, value of property sets and quantities as Set.Name (Set.Group.Name where nested), those of an element's type first; a later value of a key counts."""
    kind = one_of_each(found, "typed_by")
    of_type = instances.select("file", F.col("id").alias("parent"), F.posexplode(references(_arg(5))).alias("turn", "set"))
    by_type = kind.join(of_type, ["file", "parent"]).select("file", F.col("child").alias("element"), "set", F.array(F.lit(0).cast("bigint"), F.col("turn").cast("bigint")).alias("order"))
    own = found.where("relation = 'has_properties'").select("file", F.col("child").alias("element"), F.col("parent").alias("set"), F.array(F.lit(1).cast("bigint"), "rel").alias("order"))
    sets = by_type.unionByName(own)
    class_name = F.when(F.col("type") == "IFCPROPERTYSET", "IfcPropertySet").otherwise("IfcElementQuantity")
    heads = instances.where("type in ('IFCPROPERTYSET', 'IFCELEMENTQUANTITY')").select(
        "file", F.col("id").alias("set"), F.coalesce(F.nullif(text_of(_arg(2)), F.lit("")), class_name).alias("prefix"), (F.col("type") == "IFCELEMENTQUANTITY").alias("counts"),
        references(F.when(F.col("type") == "IFCPROPERTYSET", _arg(4)).otherwise(_arg(5))).alias("members"),
    )
    now = heads.select("file", "set", "prefix", "counts", F.posexplode("members").alias("turn", "id")).select("file", "set", "prefix", "counts", "id", F.array(F.col("turn").cast("bigint")).alias("turns"))
    # What any depth needs of a property or quantity, read once.
    kinds = F.col("type").rlike("^IFC(PROPERTY(SINGLE|ENUMERATED|LIST|BOUNDED|REFERENCE)VALUE|COMPLEXPROPERTY|QUANTITY|PHYSICAL)")
    read = instances.where(kinds).select("file", "id", "type", text_of(_arg(0)).alias("name"), value_of(_arg(2)).alias("high"), value_of(_arg(3)).alias("low"), text_of(_arg(2)).alias("said"), references(_arg(3)).alias("below"))
    read = tables.written(read.where("name <> ''"), "properties")
    values = None
    for _ in range(deepest + 1):
        met = now.join(read, ["file", "id"]).withColumn("key", F.concat("prefix", F.lit("."), "name"))
        low, high = F.col("low"), F.col("high")
        value = (
            F.when(F.col("counts"), F.when(F.col("type") != "IFCPHYSICALCOMPLEXQUANTITY", low))
            .when(F.col("type").isin("IFCPROPERTYSINGLEVALUE", "IFCPROPERTYENUMERATEDVALUE", "IFCPROPERTYLISTVALUE"), high)
            .when(F.col("type") == "IFCPROPERTYBOUNDEDVALUE", F.when((low != "") & (high != ""), F.concat(low, F.lit(" .. "), high)).otherwise(F.concat(low, high)))
            .when(F.col("type") == "IFCPROPERTYREFERENCEVALUE", F.col("said"))
        )
        part = met.select("file", "set", "key", value.alias("value"), "turns").where("value <> ''")
        values = part if values is None else values.unionByName(part)
        nested = met.where("not counts and type = 'IFCCOMPLEXPROPERTY'").select("file", "set", F.col("key").alias("prefix"), "counts", F.posexplode("below").alias("turn", "member"), "turns")
        now = nested.select("file", "set", "prefix", "counts", F.col("member").alias("id"), F.concat("turns", F.array(F.col("turn").cast("bigint"))).alias("turns"))
    each = sets.join(values, ["file", "set"])
    return each.groupBy("file", "element", "key").agg(F.max_by("value", F.struct("order", "turns")).alias("value"))


#: Fixed values of the format: what a composed material refers to, and at which place.
COMPOSED = {
    "IFCMATERIALLAYERSETUSAGE": 0, "IFCMATERIALPROFILESETUSAGE": 0, "IFCMATERIALPROFILESETUSAGETAPERING": 0, "IFCMATERIALLAYERSET": 0, "IFCMATERIALLIST": 0, "IFCMATERIALLAYER": 0,
    "IFCMATERIALPROFILESET": 2, "IFCMATERIALCONSTITUENTSET": 2, "IFCMATERIALPROFILE": 2, "IFCMATERIALCONSTITUENT": 2,
}


def materials(instances: DataFrame, found: DataFrame, deepest: int = 4) -> DataFrame:
    """file, element, material: the names of what an element is made of, each once, in order, with semicolons."""
    made = one_of_each(found, "made_of")
    now = made.select("file", F.col("parent").alias("root"), F.col("parent").alias("id"), F.array().cast("array<bigint>").alias("turns")).distinct()
    names = None
    place = F.coalesce(*(F.when(F.col("type") == k, _arg(i)) for k, i in COMPOSED.items()))
    for _ in range(deepest + 1):
        met = now.join(instances, ["file", "id"])
        part = met.where("type = 'IFCMATERIAL'").select("file", "root", text_of(_arg(0)).alias("name"), "turns").where("name <> ''")
        names = part if names is None else names.unionByName(part)
        below = F.when(F.startswith(place, F.lit("(")), references(place)).otherwise(F.filter(F.array(reference(place)), lambda r: r.isNotNull()))
        now = met.where(F.col("type").isin(*COMPOSED)).select("file", "root", "turns", F.posexplode(below).alias("turn", "id")).select("file", "root", "id", F.concat("turns", F.array(F.col("turn").cast("bigint"))).alias("turns"))
    firsts = names.groupBy("file", "root", "name").agg(F.min("turns").alias("turns"))
    joined = firsts.groupBy("file", "root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turns", "name"))), lambda x: x["name"]), "; ").alias("material"))
    return made.join(joined.withColumnRenamed("root", "parent"), ["file", "parent"]).select("file", F.col("child").alias("element"), "material")


def openings(instances: DataFrame, found: DataFrame) -> DataFrame:
    """file, host, openings: what cuts each element, in the order of the instances that say so."""
    return found.where("relation = 'voids'").groupBy("file", F.col("parent").alias("host")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rel", "child"))), lambda x: x["child"]).alias("openings"))


def facts(instances: DataFrame, found: DataFrame) -> DataFrame:
    """file, element, key, value: name, type, storey and material of elements that a relation names, where they have them."""
    elements = found.select("file", F.col("child").alias("element")).distinct()
    own = elements.join(instances.select("file", F.col("id").alias("element"), F.map_from_arrays(F.array(*map(F.lit, ("GlobalId", "Name", "Description", "ObjectType"))), F.array(*(text_of(_arg(i)) for i in (0, 2, 3, 4)))).alias("m")), ["file", "element"]).select("file", "element", F.explode("m").alias("key", "value"))
    kinds = one_of_each(found, "typed_by").join(instances.select("file", F.col("id").alias("parent"), text_of(_arg(2)).alias("value")), ["file", "parent"]).select("file", F.col("child").alias("element"), F.lit("Type").alias("key"), "value")
    levels = storeys(instances, found).select("file", F.col("id").alias("element"), F.lit("Storey").alias("key"), F.col("storey_name").alias("value"))
    made = materials(instances, found).select("file", "element", F.lit("Material").alias("key"), F.col("material").alias("value"))
    return own.unionByName(kinds).unionByName(levels).unionByName(made).where("value <> ''")


def step_instances(files: DataFrame) -> DataFrame:
    """file, id, type, args of the instances of ISO-10303-21 files (path, content); texts may hold any sign. Other files give no rows."""
    text = F.decode("content", "ISO-8859-1")
    pattern = r"#\d+\s*=\s*[A-Za-z0-9_]*\s*\((?:[^';]++|'[^']*+')*+;"
    each = files.where(F.startswith(F.ltrim(text), F.lit("ISO-10303-21"))).select(F.col("path").alias("file"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("line"))
    head = r"^#(\d+)\s*=\s*([A-Za-z0-9_]*)\s*\("
    body = F.regexp_replace(F.regexp_replace("line", head, ""), r"\)\s*;$", "")
    return each.select("file", F.regexp_extract("line", head, 1).cast("bigint").alias("id"), F.upper(F.regexp_extract("line", head, 2)).alias("type"), F.trim(body).alias("args"))
