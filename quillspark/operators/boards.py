"""Boards as relations: layer classes, job files, stack order, drill scale, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Layer classes by the FileFunction attribute of the public Gerber format, in stack order from the top.
FUNCTIONS = (
    ("legend_top", r"^legend,top"), ("paste_top", r"^paste,top"), ("mask_top", r"^soldermask,top"), ("copper_top", r"^copper,l[0-9]+,top"), ("copper_inner", r"^copper,l[0-9]+,inr"),
    ("copper_bottom", r"^copper,l[0-9]+,bot"), ("mask_bottom", r"^soldermask,bot"), ("paste_bottom", r"^paste,bot"), ("legend_bottom", r"^legend,bot"), ("outline", r"^profile"),
    ("drill_plated", r"^plated"), ("drill_plain", r"^nonplated"),
)
#: The same by usual file extensions, where a file has no attribute.
EXTENSIONS = {
    "gto": "legend_top", "gtp": "paste_top", "gts": "mask_top", "gtl": "copper_top", "gbl": "copper_bottom", "gbs": "mask_bottom", "gbp": "paste_bottom", "gbo": "legend_bottom",
    "gko": "outline", "gm1": "outline", "drl": "drill_plated", "xln": "drill_plated",
}


def layer_class(function: Column, name: Column) -> Column:
    """A layer's class by its function, else by its file's extension, else other."""
    low, out = F.lower(function), F.lit("other")
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    for e, c in EXTENSIONS.items():
        out = F.when(ext == e, c).otherwise(out)
    out = F.when(ext.rlike(r"^g[0-9]+$"), "copper_inner").otherwise(out)
    for c, pattern in reversed(FUNCTIONS):
        out = F.when(low.rlike(pattern), c).otherwise(out)
    return out


def with_functions(layers: DataFrame, job: DataFrame) -> DataFrame:
    """layers (file, function) with `function` from the file's own attribute, else from the job file (job_file, job_function) by lower-case base name."""
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]*)$", 1))
    said = job.select(base(F.col("job_file")).alias("_base"), "job_function").groupBy("_base").agg(F.min("job_function").alias("job_function"))
    met = layers.withColumn("_base", base(F.col("file"))).join(said, "_base", "left")
    return met.select("file", F.coalesce("function", "job_function").alias("function"), layer_class(F.coalesce("function", "job_function"), F.col("file")).alias("class"))


def stack_order(layers: DataFrame, key: str = "board") -> DataFrame:
    """Layers (board, file, class) with stack_no from the top; files by name within a class."""
    rank = F.array_position(F.array(*(F.lit(c) for c, _ in FUNCTIONS)), F.col("class"))
    place = F.when(rank == 0, len(FUNCTIONS) + 1).otherwise(rank)
    return layers.withColumn("stack_no", F.row_number().over(Window.partitionBy(key).orderBy(place, "file")))


#: Scales that a drill file without a header may be in, in the order in which they are tried.
SCALES = (1.0, 10.0, 0.1, 100.0, 0.01, 1 / 25.4, 10 / 25.4, 0.1 / 25.4, 25.4, 2.54, 0.254)


def drill_scale(holes: DataFrame, boxes: DataFrame) -> DataFrame:
    """file, scale, share: the scale at which most holes (file, x, y) lie in the copper's box (file, x0, y0, x1, y1).

    A thousandth of a decade counts against a scale, the earlier of two equal ones is taken, and a file stays as it is (1)
    where the best holds no more than half. share is that of the scale taken.
    """
    x, y = F.col("x"), F.col("y")
    inside = [F.avg(((x * s).between(F.col("x0"), F.col("x1")) & (y * s).between(F.col("y0"), F.col("y1"))).cast("double")).alias(f"_s{i}") for i, s in enumerate(SCALES)]
    shares = holes.join(boxes, "file").groupBy("file").agg(*inside)  # one pass over the holes
    scored = F.array(*(F.struct((F.col(f"_s{i}") - F.abs(F.log10(F.lit(s))) * 1e-3).alias("score"), F.lit(-i).alias("first"), F.lit(s).alias("scale"), F.col(f"_s{i}").alias("share")) for i, s in enumerate(SCALES)))
    best = shares.withColumn("_b", F.array_max(scored))
    fits = F.col("_b.score") > 0.5
    return best.select("file", F.when(fits, F.col("_b.scale")).otherwise(1.0).alias("scale"), F.when(fits, F.col("_b.share")).otherwise(F.col("_s0")).alias("share"))


def cells_of(items: DataFrame, grid: float, keys: tuple[str, ...] = ("board", "layer")) -> DataFrame:
    """The grid cells that boxes (x0, y0, x1, y1) touch, each once."""
    at = lambda c: F.floor(F.col(c) / grid).cast("long")
    rows = items.select(*keys, F.explode(F.sequence(at("x0"), at("x1"))).alias("cx"), at("y0").alias("_a"), at("y1").alias("_b"))
    return rows.select(*keys, "cx", F.explode(F.sequence("_a", "_b")).alias("cy")).distinct()


def compared(a: DataFrame, b: DataFrame, grid: float) -> DataFrame:
    """board, layer, only_a, only_b, both: how many grid cells two versions of each layer cover alone and together."""
    keys = ["board", "layer", "cx", "cy"]
    met = cells_of(a, grid).withColumn("a", F.lit(1)).join(cells_of(b, grid).withColumn("b", F.lit(1)), keys, "full")
    return met.groupBy("board", "layer").agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def schema_warning(schema: Column) -> Column:
    """Null for the schemas that are known (IFC2X3, IFC4 and their variants), else a warning."""
    return F.when(~F.upper(schema).rlike(r"^IFC(2X3|4)"), F.concat(F.lit("read as IFC4, the file says "), schema))


# --- file functions ---------------------------------------------------------------------------------------

#: The first field of a file function by what the layer is. Where the side stands, counted from 0, is 2 for copper and components, else 1.
KINDS = {
    "copper": ("copper",),
    "drill": ("plated", "nonplated"),
    "outline": ("profile",),
    "mask": ("soldermask",),
    "silk": ("legend",),
    "paste": ("paste",),
    "component": ("component",),
    "other": ("glue", "carbonmask", "goldmask", "heatsinkmask", "peelablemask", "silvermask", "tinmask", "depthrout", "vcut", "viafill", "pads", "other"),
    "drawing": ("drillmap", "fabricationdrawing", "vcutmap", "assemblydrawing", "arraydrawing", "otherdrawing"),
}


def layer_facts(function: Column) -> Column:
    """struct(kind, side, layer_no, plated) of a file function such as Copper,L2,Inr; kind is null where the function is none of the format's.

    Copper without a side is on top as layer 1 and inside else. Holes and outlines are on both sides; other kinds without
    a side have none.
    """
    field = lambda i: F.trim(F.coalesce(F.get(F.split(function, ",", -1), F.lit(i)), F.lit("")))
    what = F.lower(field(0))
    kind = F.lit(None).cast("string")
    for k, names in KINDS.items():
        kind = F.when(what.isin(*names), k).otherwise(kind)
    deep = what.isin("copper", "component")
    said = F.lower(F.when(deep, field(2)).otherwise(field(1)))
    side = F.when(said.startswith("top"), "top").when(said.startswith("bot"), "bottom").when(said.startswith("inr"), "inner")
    number = F.coalesce(F.regexp_extract(field(1), r"^[Ll]?\s*([0-9]+)", 1).try_cast("int"), F.lit(0))
    side = F.when(what == "copper", F.coalesce(side, F.when(number == 1, "top").otherwise("inner"))).when(what.isin("plated", "nonplated", "profile"), "both").when(what != "other", side)
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), side).alias("side"), F.when(deep, number).otherwise(0).alias("layer_no"), F.when(what == "plated", True).when(what == "nonplated", False).alias("plated"))
