import random

from pyspark.sql import functions as F

from quillspark.operators import buildings as B


def split(spark, *args):
    df = spark.createDataFrame([(a,) for a in args], "args string")
    return [r[0] for r in df.select(B.arguments(F.col("args"))).collect()]


def by_hand(text):
    """Arguments by one walk over the signs."""
    out, depth, quoted, now = [], 0, False, ""
    for ch in text:
        if ch == "'":
            quoted = not quoted
        elif not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                out.append(now.strip())
                now = ""
                continue
        now += ch
    return [*out, now.strip()] if text.strip() else []


def test_arguments(spark):
    r = random.Random(1)
    texts = ["", "$", "'a,b',(#1, #2),IFCLABEL('Brick (red)'),.T.", "'O''Neil','','(',$", "((1.,2.),(3.,4.)),*,'x'"]
    for _ in range(60):
        part = lambda: r.choice(["$", "#12", "1.5", ".T.", "'a'", "'it''s, (so)'", "IFCREAL(2.)", "(#1, #2)", "((1,2),(3))", "IFCLABEL('x,)')"])
        texts.append(" , ".join(part() for _ in range(r.randint(1, 9))))
    assert split(spark, *texts) == [by_hand(t) for t in texts]


def test_values(spark):
    cases = {
        "IFCLABEL('Brick (red)')": "Brick (red)", "IFCLABEL('O''Neil')": "O'Neil", "IFCREAL(7.)": "7", "IFCREAL(2.50000049)": "2.5", "IFCINTEGER(-12)": "-12", "IFCBOOLEAN(.T.)": "TRUE", "IFCLOGICAL(.U.)": "UNKNOWN",
        ".NOTDEFINED.": "NOTDEFINED", "$": "", "#17": "#17", "(IFCLABEL('a'),IFCLABEL('b, c'))": "a, b, c", "IFCLABEL(' ')": " ", "IFCTEXT('\\X2\\00E400DF\\X0\\x \\X\\E9')": "äßx é", "1.E3": "1000",
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert dict(map(tuple, df.select("a", B.value_of(F.col("a"))).collect())) == cases


MODEL = """1|IFCPROJECT|'p',$,'P'
2|IFCBUILDING|'b',$,'B'
3|IFCBUILDINGSTOREY|'s1',$,'Ground'
4|IFCBUILDINGSTOREY|'s2',$,'',$,$,$,$,'Upper'
5|IFCWALL|'w1',$,'W1',$,$,$,$,'t'
6|IFCWALL|'w2',$,'W2'
7|IFCBUILDINGELEMENTPART|'q',$,'Q'
8|IFCFURNITURE|'f',$,'F'
9|IFCBRIDGEPART|'bp',$,'Deck'
10|IFCBEAM|'be',$,'Beam'
18|IFCSPACE|'sp',$,'Room'
11|IFCRELAGGREGATES|'r1',$,$,$,#1,(#2)
12|IFCRELAGGREGATES|'r2',$,$,$,#2,(#3, #4)
13|IFCRELCONTAINEDINSPATIALSTRUCTURE|'r3',$,$,$,(#5),#3
14|IFCRELCONTAINEDINSPATIALSTRUCTURE|'r4',$,$,$,(#6, #8),#4
15|IFCRELAGGREGATES|'r5',$,$,$,#5,(#7)
16|IFCRELCONTAINEDINSPATIALSTRUCTURE|'r6',$,$,$,(#8),#2
17|IFCRELCONTAINEDINSPATIALSTRUCTURE|'r7',$,$,$,(#10),#9
19|IFCRELNESTS|'r8',$,$,$,#6,(#7)
20|IFCRELVOIDSELEMENT|'r9',$,$,$,#5,#31
21|IFCRELVOIDSELEMENT|'ra',$,$,$,#5,#30
22|IFCPROPERTYSINGLEVALUE|'Owner',$,IFCLABEL('O''Neil (jr)'),$
23|IFCCOMPLEXPROPERTY|'Group',$,'u',(#22, #24)
24|IFCCOMPLEXPROPERTY|'Sub',$,'u',(#25)
25|IFCPROPERTYBOUNDEDVALUE|'Span',$,IFCREAL(9.5),IFCREAL(2.),$
26|IFCPROPERTYSET|'ps',$,'Pset',$,(#22,#23)
27|IFCRELDEFINESBYPROPERTIES|'rb',$,$,$,(#5, #6),#26
28|IFCQUANTITYLENGTH|'Height',$,$,2.75
29|IFCELEMENTQUANTITY|'q',$,$,$,$,(#28)
32|IFCRELDEFINESBYPROPERTIES|'rc',$,$,$,(#5),#29
33|IFCPROPERTYSINGLEVALUE|'Owner',$,IFCLABEL('type'),$
34|IFCPROPERTYSET|'pt',$,'Pset',$,(#33,#36)
35|IFCWALLTYPE|'t',$,'Brick wall',$,$,(#34)
36|IFCPROPERTYENUMERATEDVALUE|'Kind',$,(IFCLABEL('a'),IFCLABEL('b')),$
37|IFCRELDEFINESBYTYPE|'rd',$,$,$,(#5,#6),#35
40|IFCMATERIAL|'Brick'
41|IFCMATERIAL|'Foam'
42|IFCMATERIALLAYER|#40,0.1
43|IFCMATERIALLAYER|#41,0.1
44|IFCMATERIALLAYERSET|(#42,#43,#42),'set'
45|IFCMATERIALLAYERSETUSAGE|#44
46|IFCRELASSOCIATESMATERIAL|'re',$,$,$,(#5),#45
47|IFCRELASSOCIATESMATERIAL|'rf',$,$,$,(#6),#41
50|IFCWALL|'x',$,'X'
51|IFCWALL|'y',$,'Y'
52|IFCRELAGGREGATES|'rg',$,$,$,#50,(#51)
53|IFCRELAGGREGATES|'rh',$,$,$,#51,(#50)"""


def test_a_building(spark):
    rows = [(f, int(i), t, a) for f in (1, 2) for i, t, a in (line.split("|") for line in MODEL.split("\n"))]
    instances = B.parsed(spark.createDataFrame(rows, "file long, id long, type string, args string"))
    found = B.links(instances)
    level = {r["id"]: (r["storey"], r["storey_name"]) for r in B.storeys(instances, found).where("file = 1").collect()}
    # The later containment of 8 counts: a building is no level. 7 is part of 5 first. A circle stands nowhere.
    assert level == {3: (3, "Ground"), 4: (4, "Upper"), 5: (3, "Ground"), 6: (4, "Upper"), 7: (3, "Ground"), 10: (9, "Deck")}
    values = {(r["element"], r["key"]): r["value"] for r in B.property_values(instances, found).where("file = 2").collect()}
    common = {"Pset.Owner": "O'Neil (jr)", "Pset.Group.Owner": "O'Neil (jr)", "Pset.Group.Sub.Span": "2 .. 9.5", "Pset.Kind": "a, b"}
    assert values == {(e, k): v for e in (5, 6) for k, v in common.items()} | {(5, "IfcElementQuantity.Height"): "2.75"}
    assert {(r["element"], r["material"]) for r in B.materials(instances, found).where("file = 1").collect()} == {(5, "Brick; Foam"), (6, "Foam")}
    assert [tuple(r) for r in B.openings(instances, found).where("file = 1").collect()] == [(1, 5, [31, 30])]
    said = {(r["element"], r["key"]): r["value"] for r in B.facts(instances, found).where("file = 1").collect()}
    assert said[5, "Type"] == "Brick wall" and said[5, "Storey"] == "Ground" and said[7, "Storey"] == "Ground" and said[6, "Material"] == "Foam" and (8, "Storey") not in said
