"""Buildings over whole tables: an IFC file for each nation, a wall with its properties for each customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buildings as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_HEAD = """ISO-10303-21;
DATA;
#1= IFCPROJECT('p',#9,'P');
#2= IFCBUILDING('b',#9,'B');
#3= IFCBUILDINGSTOREY('s1',#9,'Ground; (0)');
#4= IFCBUILDINGSTOREY('s2',#9,'',$,$,$,$,'Upper');
#5= IFCMATERIAL('Brick');
#6= IFCMATERIAL('Foam');
#7= IFCMATERIALLAYER(#5,0.1);
#8= IFCMATERIALLAYER(#6,0.1);
#10= IFCMATERIALLAYERSET((#7,#8,#7),'set');
#11= IFCMATERIALLAYERSETUSAGE(#10);
#12= IFCRELAGGREGATES('r1',#9,$,$,#1,(#2));
#13= IFCRELAGGREGATES('r2',#9,$,$,#2,(#3, #4));
#14= IFCWALLTYPE('t',#9,'Kind',$,$,(#16));
#15= IFCPROPERTYSINGLEVALUE('Segment',$,IFCLABEL('of the type'),$);
#16= IFCPROPERTYSET('pt',#9,'Pset',$,(#15));
"""
#: A wall on the ground, on the upper floor or in the building alone; its set, with a nested group, a quantity, an opening; every second has a type and a material.
_WALL = """#@0= IFCWALL('g',#9,'NAME',$,$,$,$,'t');
#@1= IFCRELCONTAINEDINSPATIALSTRUCTURE('c',#9,$,$,(#@0),#PLACE);
#@2= IFCPROPERTYSINGLEVALUE('Segment',$,IFCLABEL('SEGMENT (''x'')'),$);
#@3= IFCCOMPLEXPROPERTY('Deep',$,'u',(#@2, #@4));
#@4= IFCPROPERTYBOUNDEDVALUE('Span',$,IFCREAL(9.50),IFCREAL(2.),$);
#@5= IFCQUANTITYAREA('Area',$,$,KEY.5);
#@6= IFCELEMENTQUANTITY('q',#9,'Base',$,$,(#@5));
#@7= IFCPROPERTYSET('s',#9,'Pset',$,(#@2,#@3));
#@8= IFCRELDEFINESBYPROPERTIES('x',#9,$,$,( #@0 ),#@7);
#@9= IFCRELDEFINESBYPROPERTIES('x',#9,$,$,(#@0),#@6);
"""
_EXTRA = """#9@0= IFCRELVOIDSELEMENT('v',#9,$,$,#@0,#@5);
#9@1= IFCRELDEFINESBYTYPE('d',#9,$,$,(#@0),#14);
#9@2= IFCRELASSOCIATESMATERIAL('m',#9,$,$,(#@0),#11);
"""


def _instances(spark, d):
    key, wall = F.col("c_custkey"), F.lit(_WALL)
    body = F.when(key % 2 == 0, F.concat(wall, F.lit(_EXTRA))).otherwise(wall)
    place = F.element_at(F.array(*map(F.lit, ("2", "3", "4"))), (key % 3 + 1).cast("int"))
    for mark, by in (("@", (key + 1000).cast("string")), ("NAME", F.col("c_name")), ("PLACE", place), ("SEGMENT", F.col("c_mktsegment")), ("KEY", key.cast("string"))):
        body = F.replace(body, F.lit(mark), by)
    whole = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.concat(F.lit(_HEAD), F.array_join(F.array_sort(F.collect_list(body)), ""), F.lit("ENDSEC;\nEND-ISO-10303-21;")).alias("text"))
    return B.parsed(B.step_instances(whole.select(F.col("c_nationkey").cast("bigint").alias("path"), F.col("text").cast("binary").alias("content"))))


_W = "w AS (SELECT CAST(c_nationkey AS BIGINT) AS file, (c_custkey + 1000) * 10 AS id, c_custkey AS k, c_name, c_mktsegment AS s FROM customer), n AS (SELECT DISTINCT file FROM w)"


@query(f"""WITH {_W} SELECT file, 'contained_in' AS relation, id AS child, k % 3 + 2 AS parent FROM w UNION ALL SELECT file, 'has_properties', id, id + v FROM w, (VALUES (6), (7)) x(v)
UNION ALL SELECT file, r, CASE r WHEN 'voids' THEN id + 5 ELSE id END, CASE r WHEN 'voids' THEN id WHEN 'typed_by' THEN 14 ELSE 11 END FROM w, (VALUES ('voids'), ('typed_by'), ('made_of')) x(r) WHERE k % 2 = 0
UNION ALL SELECT file, 'part_of', c, p FROM n, (VALUES (2, 1), (3, 2), (4, 2)) x(c, p)""")
def jn_ifc_relations(spark, d):
    return B.links(_instances(spark, d)).drop("rel")


@query(f"""WITH {_W} SELECT file, id, k % 3 + 2 AS storey, CASE k % 3 WHEN 1 THEN 'Ground; (0)' ELSE 'Upper' END AS storey_name FROM w WHERE k % 3 > 0
UNION ALL SELECT file, id, id, name FROM n, (VALUES (3, 'Ground; (0)'), (4, 'Upper')) x(id, name)""")
def jn_ifc_storeys(spark, d):
    """Walls that stand in the building alone are on no level; storeys are their own."""
    e = _instances(spark, d)
    return B.storeys(e, B.links(e))


@query(f"""WITH {_W} SELECT file, id AS element, key, CASE key WHEN 'Pset.Deep.Span' THEN '2 .. 9.5' WHEN 'Base.Area' THEN k || '.5' ELSE s || ' (''x'')' END AS value
FROM w, (VALUES ('Pset.Segment'), ('Pset.Deep.Segment'), ('Pset.Deep.Span'), ('Base.Area')) x(key)""")
def jn_ifc_properties(spark, d):
    """An element's own value of a key counts against its type's."""
    e = _instances(spark, d)
    return B.property_values(e, B.links(e))


@query(f"""WITH {_W} SELECT file, id AS element, 'Brick; Foam' AS material, c_name || '/Kind' AS said FROM w WHERE k % 2 = 0""")
def jn_ifc_materials(spark, d):
    e = _instances(spark, d)
    found = B.links(e)
    said = B.facts(e, found).where("key in ('Name', 'Type')").groupBy("file", "element").pivot("key", ["Name", "Type"]).agg(F.first("value"))
    return B.materials(e, found).join(said, ["file", "element"]).select("file", "element", "material", F.concat("Name", F.lit("/"), "Type").alias("said"))


@query(f"""WITH {_W} SELECT file, id AS host, CAST(id + 5 AS VARCHAR) AS openings FROM w WHERE k % 2 = 0""")
def jn_ifc_openings(spark, d):
    e = _instances(spark, d)
    return B.openings(e, B.links(e)).select("file", "host", F.array_join(F.transform("openings", lambda x: x.cast("string")), " ").alias("openings"))
