import itertools
import random

from pyspark.sql import functions as F

from quillspark.llm import url_rules

BIG = "/root/testdata/sf0.1"


def brute(rows, least, confidence):
    """Rules of (tokens, block) rows after tokens with the same rows are made one."""
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(i)
    blocked = {i for i, (_, b) in enumerate(rows) if b}
    often = {t: frozenset(w) for t, w in where.items() if len(w & blocked) >= least}
    first = {}
    for t in sorted(often):
        first.setdefault(often[t], t)
    use = set(first.values())
    good = {}
    for n in range(1, 4):
        for c in itertools.combinations(sorted(use), n):
            fits = frozenset.intersection(*(often[t] for t in c))
            if len(fits & blocked) >= least and len(fits & blocked) / len(fits) >= confidence:
                good[c] = len(fits & blocked) / len(fits)
    return {c: p for c, p in good.items() if not any(set(d) < set(c) and good[d] >= p for d in good)}


def test_mined_rules_equal_brute_force(spark):
    urls = url_rules.split_urls(spark.read.parquet(f"{BIG}/pages.parquet"))
    labelled = url_rules.labelled_urls(urls, spark.read.parquet(f"{BIG}/labels.parquet"))
    rows = [(r["tokens"], r["block"]) for r in labelled.collect()]
    base = sum(b for _, b in rows) / len(rows)
    want = brute(rows, 20, url_rules.MIN_LIFT * base)
    got = {tuple(r["rule_tokens"]): r["confidence"] for r in url_rules.learn_rules(labelled).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in got) and len(got) > 0


def test_query_judges_by_list_rules_and_default(spark):
    urls = url_rules.split_urls(spark.read.parquet(f"{BIG}/pages.parquet"))
    labelled = url_rules.labelled_urls(urls, spark.read.parquet(f"{BIG}/labels.parquet"))
    rules = {tuple(r["rule_tokens"]): r["confidence"] for r in url_rules.significant_rules(labelled).collect()}
    judged = url_rules.op9_url_rules(spark, BIG).collect()
    print(len(rules), "rules hold, which decide", sum(r["rule"] is None and r["mined"] is not None for r in judged), "of", sum(r["rule"] is None for r in judged), "urls that no given rule fits")
    tokens = {r["page_id"]: set(r["tokens"]) for r in urls.select("page_id", "tokens").collect()}
    for r in judged:
        fits = [(-p, -len(c), " ".join(c)) for c, p in rules.items() if set(c) <= tokens[r["page_id"]]]
        assert r["mined"] == (min(fits)[2] if fits else None)
        assert r["verdict"] == ({"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}[r["rule"]] if r["rule"] else "block" if fits else "allow")


def made_up(r, n, planted):
    """Urls of tokens at random; a planted combination is blocked nine times in ten, any other url once in four."""
    rows = []
    for i in range(n):
        tokens = {f"s:{r.choice('ab')}", f"h:{r.randint(0, 12)}", f"p:{r.randint(0, 6)}", f"q:{r.randint(0, 9)}"}
        if planted and i % 8 == 0:
            tokens |= {"w:cheap", "w:pills"}
        elif planted and i % 8 in (1, 2, 3, 4):
            tokens |= {r.choice(["w:cheap", "w:pills"])}
        both = {"w:cheap", "w:pills"} <= tokens
        rows.append((i, sorted(tokens), r.random() < (0.9 if both else 0.25)))
    return rows


SCHEMA = "doc_id long, tokens array<string>, block boolean"


def test_shuffled_labels_give_no_rule(spark):
    rows = [(i, t, b) for i, t, b in made_up(random.Random(1), 900, False)]
    for draw in range(20):
        blocks = [b for *_, b in rows]
        random.Random(draw).shuffle(blocks)
        shuffled = spark.createDataFrame([(i, t, b) for (i, t, _), b in zip(rows, blocks, strict=True)], SCHEMA)
        assert url_rules.significant_rules(shuffled).isEmpty()


def test_planted_rules_are_found(spark):
    got = url_rules.significant_rules(spark.createDataFrame(made_up(random.Random(2), 2400, True), SCHEMA)).collect()
    assert ["w:cheap", "w:pills"] in [r["rule_tokens"] for r in got] and all({"w:cheap", "w:pills"} <= set(r["rule_tokens"]) for r in got)
    judged = {tuple(r["rule_tokens"]): r["confidence"] for r in got}
    assert 0.8 < judged["w:cheap", "w:pills"] <= 1


def test_lower_bound(spark):
    got = spark.range(1).select(url_rules.lower_bound(F.lit(20), F.lit(20), 0.05), url_rules.lower_bound(F.lit(30), F.lit(100), 0.025)).first()
    assert abs(got[0] - 0.8808) < 1e-3 and abs(got[1] - 0.2190) < 1e-3


def test_tokens(spark):
    rows = [(1, "HTTPS://a.my-shop.com/x/12/y.html?id=3&Q&=4#f?z=1"), (2, None), (3, "no scheme"), (4, "://"), (5, "ftp://h" + "/s" * 40_000)]
    got = {r["page_id"]: r["tokens"] for r in url_rules.split_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ["s:https", "h:a", "h:my-shop", "h:com", "w:my", "w:shop", "p:x", "p:y.html", "e:html", "q:id", "q:Q"]
    assert got[2] == got[3] == got[4] == [] and got[5] == ["s:ftp", "h:h", "p:s"]


def test_empty_and_clashing(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "x", 2, 3)], "page_id long, url string, mined string, row int, tokens int")
    urls = url_rules.split_urls(pages)
    none = url_rules.learn_rules(urls.select("tokens", F.lit(True).alias("block")).limit(0))
    given = url_rules.given_rules(spark, url_rules.RULES)
    assert [(r["rule"], r["verdict"], r["mined"]) for r in url_rules.judge(urls, given, none).collect()] == [("net/", "block", None)]
    assert url_rules.judge(urls.limit(0), given, none).count() == 0


def test_tokens_that_always_stand_together_make_one_rule(spark):
    rows = [([f"t{j}" for j in range(22)] + [f"u{i}"], True) for i in range(30)] + [([f"v{i}"], False) for i in range(200)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, block boolean")
    assert [r["rule_tokens"] for r in url_rules.learn_rules(labelled).collect()] == [["t0"]]
