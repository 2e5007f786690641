"""Fill-in-middle cuts by relations of units.

A unit is a run of ASCII letters or one other code point. Texts are matched into runs of up to GRAIN units; the runs'
lengths are exploded with their positions, a window sums them, and the cut requests of a document (an ordinal of a
unit each) meet the run that holds their unit. The unit lengths of these runs alone are exploded again, summed by a
window and met by what is left of the ordinal. Offsets are then aggregated by document, and prefix, middle and suffix are
substrings of the text, which moves once. Facts and lengths are written as a small table in between, so the units of
a text are matched once, and rows that repeat share them.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain; a null doc_id counts
as an empty one in the hash; rows that repeat are formatted alike, each; a text of any length is cut whole; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialize

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of one run.
GRAIN = 32
#: Of 100 documents, those that are cut; of 100 of these, those with the suffix first.
CUT_SHARE, SPM_SHARE = 90, 20
_KEY = ["id", "text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the key (id, text_hash), never null, that tells documents apart where ids repeat or are null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("*", F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("text_hash"))


def _draw(i: int) -> Column:
    """The i-th 8-digit group of the document's hash, as an unsigned integer."""
    return F.conv(F.substring("digest", 8 * i - 7, 8), 16, 10).cast("long")


def _facts(rows: DataFrame, grain: int, cut_share: int, spm_share: int) -> DataFrame:
    """The key, n, form, cuts (which, ordinal) above 0, lengths of the runs, and the lengths of the units of the runs that hold a cut."""
    runs = F.regexp_extract_all("text", F.lit(f"(?:[A-Za-z]++|[^A-Za-z]){{1,{grain}}}+"), F.lit(0))
    units = lambda run: F.regexp_extract_all(run, F.lit(UNIT), F.lit(0))
    full = F.greatest(F.size("runs") - 1, F.lit(0)).cast("long") * grain
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    seen = rows.select(*_KEY, runs.alias("runs"), ((F.col("text") == "") | marked).alias("whole"), digest.alias("digest"))
    counted = seen.withColumn("n", F.when(F.size("runs") == 0, F.lit(0).cast("long")).otherwise(full + F.size(units(F.element_at("runs", -1)))))
    form = F.when(F.col("whole") | (_draw(3) % 100 >= cut_share), "plain").when(_draw(4) % 100 < spm_share, "spm").otherwise("psm")
    a, b = _draw(1) % (F.col("n") + 1), _draw(2) % (F.col("n") + 1)
    formed = counted.withColumn("form", form).withColumn("a", F.least(a, b)).withColumn("b", F.greatest(a, b))
    cuts = F.filter(F.array(F.struct(F.lit("prefix").alias("which"), F.col("a").alias("ordinal")), F.struct(F.lit("middle").alias("which"), F.col("b").alias("ordinal"))), lambda c: c["ordinal"] > 0)
    asked = F.array_distinct(F.transform("cuts", lambda c: F.floor((c["ordinal"] - 1) / grain).cast("int")))
    held = F.map_from_entries(F.transform(asked, lambda g: F.struct(g, F.transform(units(F.get("runs", g)), F.length))))
    plain = F.col("form") == "plain"
    return (
        formed.withColumn("cuts", F.when(plain, F.slice(cuts, 1, 0)).otherwise(cuts))
        .select(*_KEY, "n", "form", "cuts", F.when(plain, F.array().cast("array<int>")).otherwise(F.transform("runs", F.length)).alias("lengths"), held.alias("held"))
    )


def cut_offsets(facts: DataFrame, grain: int = GRAIN) -> DataFrame:
    """id, text_hash, prefix_end, middle_end in code points, of the documents that have a cut above 0."""
    facts = facts.where("size(cuts) > 0").dropDuplicates(_KEY)
    before = F.coalesce(F.sum("chars").over(Window.partitionBy(*_KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = facts.select(*_KEY, "held", F.posexplode("lengths").alias("run", "chars")).select(*_KEY, "run", "chars", F.try_element_at("held", F.col("run")).alias("units"))
    summed = runs.withColumn("before", before).where("units is not null")
    asked = facts.select(*_KEY, F.explode("cuts").alias("c")).select(
        *_KEY, "c.which", F.floor((F.col("c.ordinal") - 1) / grain).cast("int").alias("run"), ((F.col("c.ordinal") - 1) % grain).cast("int").alias("left")
    )
    met = summed.join(asked, [*_KEY, "run"])
    units = met.select(*_KEY, "run", "which", "left", "before", F.posexplode("units").alias("unit", "chars")).where("unit <= left")
    end = F.sum("chars").over(Window.partitionBy(*_KEY, "run", "which").orderBy("unit"))
    ends = units.withColumn("end", F.col("before") + end).where("unit = left")
    one = lambda which: F.coalesce(F.max(F.when(F.col("which") == which, F.col("end"))), F.lit(0))
    return ends.groupBy(*_KEY).agg(one("prefix").alias("prefix_end"), one("middle").alias("middle_end"))


def fill_in_middle(docs: DataFrame, grain: int = GRAIN, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null where plain), output."""
    rows = _keyed(docs)
    facts = materialize(_facts(rows, grain, cut_share, spm_share), "units")
    once = facts.select(*_KEY, "n", "form").dropDuplicates(_KEY)
    cut = once.join(cut_offsets(facts, grain), _KEY, "left").select(*_KEY, "n", "form", F.coalesce("prefix_end", F.lit(0)).alias("p"), F.coalesce("middle_end", F.lit(0)).alias("m"))
    both = rows.join(cut.hint("shuffle_hash"), _KEY)
    piece = lambda start, length: F.substring("text", (start + 1).cast("int"), length.cast("int"))
    p, m = F.col("p"), F.col("m")
    prefix, middle, suffix = piece(F.lit(0), p), piece(p, m - p), piece(m, F.length("text") - m)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    )
    cut_only = F.col("form") != "plain"
    return both.select("doc_id", "text", "n", "form", F.when(cut_only, p).alias("prefix_chars"), F.when(cut_only, m - p).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from what was made of it: sentinels are found, as no text that was cut holds one."""
    marks = {"psm": (PREFIX, SUFFIX, MIDDLE, [0, 2, 1]), "spm": (SUFFIX, PREFIX, MIDDLE, [1, 2, 0])}
    text = output
    for name, (one, two, three, order) in marks.items():
        second, third = F.position(F.lit(two), output), F.position(F.lit(three), output)
        start = len(one) + 1
        spans = [(F.lit(start), second - start), (second + len(two), third - second - len(two)), (third + len(three), F.length(output))]
        text = F.when(form == name, F.concat(*(F.substring(output, *spans[i]) for i in order))).otherwise(text)
    return text


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || d[1:8])::UBIGINT AS h1, ('0x' || d[9:16])::UBIGINT AS h2, ('0x' || d[17:24])::UBIGINT AS h3, ('0x' || d[25:32])::UBIGINT AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": SQL}
