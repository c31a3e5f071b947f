import random
import re

import pytest
from pyspark.sql import functions as F

from vakanz.functions import fields as V
from vakanz.functions import html as H
from vakanz.functions import links as L
from vakanz.functions import render as R
from vakanz.functions import text as X
from vakanz.functions.arrays import matching_ends
from vakanz.functions.stopwords import BUILT_IN, ENGLISH, GERMAN
from vakanz.operators import links as LK
from vakanz.plans import vocabulary


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("r")).first()["r"]


def each(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in rows]


def test_entities(spark):
    texts = ["a &auml; b", "&#228;&#xE4;", "&amp;lt;", "&#8364;", "&#99999999;", "&#55296;", "&amp;"]
    assert each(spark, H.decode_entities, texts) == [
        "a ä b", "ää", "&lt;", "€", "&#99999999;", "&#55296;", "&",
    ]


def test_nodes(spark):
    page = (
        "lead text<!-- <b>no</b> --><p class=\"a>b\">Hello<br>tail<b style='x'>Head &uuml;</b>after"
        "<SCRIPT>var a='<i>x</i>';</SCRIPT><style>p{}</style><i/>"
    )
    nodes = one(spark, H.nodes(H.strip_code(F.col("p")), with_attrs=True), p=page)
    assert [(n["tag"], n["text"]) for n in nodes] == [
        ("p", "lead text"), ("p", "Hello"), ("br", ""), ("b", "Head ü"), ("i", ""),
    ]
    assert nodes[1]["attrs"] == ' class="a>b"'


def test_late_text(spark):
    pages = [
        "<div><p><i>a</i>lang genug</p>tail nach p</div>",
        "<p><br>nach br</p><p>x<br>nach br</p>",
        "<ul><li><b>fett</b>kurz</li><li><b>fett</b>abc</li></ul>ende",
        "<div></span>text zuerst<p>b</p></div>",
        "<p><i>a</i>&auml;bc</p><p><i>a</i>&auml;bcd</p>",
    ]
    assert each(spark, lambda p: H.late_text_elements(p, 4), pages) == [[1, 0], [0], [1], [0], [2]]
    flags = each(spark, H.may_have_late_text, [*pages, "<b>kopf</b><p>text</p>"])
    assert flags == [True, True, True, True, True, False]


def test_attribute(spark):
    attrs = [' href="/a?x=1&amp;y=2"', " href='b'", " data-href=x HREF = c", ' title="href=q"', " href"]
    assert each(spark, lambda a: H.attribute(a, "href"), attrs) == ["/a?x=1&y=2", "b", "c", None, ""]


def test_json_scripts(spark):
    page = (
        '<script>1</script><script type="application/ld+json">{"a":1}</script>'
        "<script id=x type='application/ld+json' async>{\"b\":2}</script>"
    )
    assert one(spark, H.json_scripts(F.col("p")), p=page) == ['{"a":1}', '{"b":2}']


def test_element_body(spark):
    pattern = r"\Wmaincontent\W"
    pages = [
        '<div class="x maincontent y">a<div>b</div>c</div><div>d</div>',
        '<div class="maincontent">a</div>',
        "<div id=1 class='a-maincontent-b'><p>t</p>",
    ]
    body = each(spark, lambda p: H.element_body(p, "div", pattern), pages)
    assert body == ["a<div>b</div>c", None, "<p>t</p>"]
    assert one(spark, H.text_content(F.col("p")), p="a<b>b</b> &lt;c&gt;") == "ab <c>"


def test_sanitize(spark):
    lines = [
        ["Das - Wir.  biäten: 3 x", "abc!"],
        ["Das - Wir.  biäten: 3 x", "abcd!"],
        [None, "abcde", "fghij"],
        ["", "abcde", "fghij"],
        ["12", None, "abcde", "fghij"],
        [],
    ]
    assert each(spark, X.sanitize, lines, "array<string>") == [
        [], ["das wir biäten x", "abcd"], [], [], ["abcde", "fghij"], [],
    ]


def test_sanitize_is_idempotent(spark):
    once = [["erste zeile", "zweite zeile ä"]]
    assert each(spark, X.sanitize, once, "array<string>") == once


def test_tokens_and_words(spark):
    assert one(spark, X.tokens(F.col("t"), BUILT_IN), t="Über die 3 C# Ä Aufgaben") == ["aufgaben"]
    text = "short sixsix  zwischen None sixsix"
    assert one(spark, X.split_words(F.col("t")), t=text) == text.split(" ")
    assert one(spark, X.ranked_words(F.col("t"), BUILT_IN), t=text) == ["sixsix", "sixsix"]
    masked = one(spark, X.bucketed_words(F.col("t"), BUILT_IN), t=text)
    assert masked == [None, "sixsix", None, None, None, "sixsix"]
    counts = one(spark, X.term_counts(F.split("t", " ")), t="b a b c b")
    assert [(c["term"], c["tf"]) for c in counts] == [("a", 1), ("b", 3), ("c", 1)]


def test_stop_lists_keep_the_words_that_tell_headings_apart():
    exact = {term for _, term, d, _, _ in vocabulary.entries("as_written") if d == 0}
    assert exact & set(BUILT_IN) == {"meine"}
    assert len(set(ENGLISH)) < 200 and len(set(GERMAN)) < 200


def test_result_pages(spark):
    texts = ["(312 Jobs gefunden)", "(7 Jobs gefunden)", "(12345 Jobs gefunden)", "312 Jobs gefunden"]
    assert each(spark, L.result_count, texts) == [312, None, None, None]
    numbers = dict(
        zip(
            (0, 10, 25, 30, 250, 260, 1000, 5000),
            each(spark, L.page_numbers, [0, 10, 25, 30, 250, 260, 1000, 5000], "int"),
        )
    )
    last = list(range(10, 41))
    assert numbers == {
        0: [0], 10: [0, 1], 25: [1], 30: [1, 2], 250: [10], 260: [10, 11], 1000: last, 5000: last,
    }


def test_job_id(spark):
    links = ["/job/0a1b2c3d4-x", "/job/ABCDEF123", "/jobs/go"]
    assert each(spark, L.job_id, links) == ["0a1b2c3d4-", "ABCDEF123", None]


@pytest.mark.parametrize(
    "record, field, expected",
    [
        ('{"industry":["IT/Software","Bank"]}', "industry", "it/software,bank"),
        ('{"industry":"IT"}', "industry", "it"),
        ("{}", "industry", None),
        ('{"industry":[]}', "industry", ""),
        ("{broken", "industry", None),
    ],
)
def test_joined_field(spark, record, field, expected):
    assert one(spark, V.joined_field(V.parse_json(F.col("j")), f"$.{field}"), j=record) == expected


def test_dates_and_locations(spark):
    dates = ['{"d":"2018-07-15"}', '{"d":"2018-13-01"}', "{}"]
    found = each(spark, lambda j: V.date_field(V.parse_json(j), "$.d").cast("string"), dates)
    assert found == ["2018-07-15", None, None]
    places = ['{"l":[{"geo":{"latitude":1.5,"longitude":"2"}}]}', '{"l":[{}]}', '{"l":{}}', "{}"]
    found = each(spark, lambda j: V.location_field(V.parse_json(j), "$.l[0].geo"), places)
    assert [f and tuple(f) for f in found] == [(1.5, 2.0), None, None, None]


def test_rendering(spark):
    assert one(spark, R.mean2(F.lit(9), F.lit(8))) == 1.12
    assert one(spark, R.mean2(F.lit(9), F.lit(0))) is None
    titles = ["Über-Ingenieur (m/w) für Straßenbau", None]
    assert each(spark, lambda t: R.file_name(t, F.lit("id")), titles) == ["ÜberIngenieurmwfürSt" + "id", "unknownid"]
    assert one(spark, R.report_line(F.lit("begriff"), F.lit(3))) == "begriff,3"
    assert one(spark, R.fingerprint([F.lit(""), F.lit("a")])) != one(
        spark, R.fingerprint([F.lit(None).cast("string"), F.lit("a")])
    )


def test_vocabulary():
    rows = vocabulary.entries()
    assert ("tasks", "task", 1, 4, 3.0) in rows and ("tasks", "bringen", 0, 0, -0.5) in rows
    assert ("requirements", "vorkenntniss", 2, 12, 2.0) in rows
    assert ("benefits", "freuenyou", 2, 3, 1.0) in rows
    written = vocabulary.entries("as_written")
    assert ("benefits", "geboten", 0, 0, 1.5) in written and ("benefits", "freuen", 0, 0, 1.0) in written
    assert len(written) == len(rows) + 5


def test_running_values_over_blocks(spark):
    import random
    from itertools import accumulate

    from vakanz.functions import arrays as A

    rng = random.Random(1)
    lists = [[rng.randrange(50) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    rows = spark.createDataFrame([(x,) for x in lists], "v array<bigint>")
    found = rows.select("v", A.running_sums(F.col("v")).alias("sums"), A.running_maxima(F.col("v")).alias("most"))
    for row in found.collect():
        assert row["sums"] == list(accumulate(row["v"])) and row["most"] == list(accumulate(row["v"], max))


def _random_page(rng):
    out = []
    for _ in range(rng.randrange(1, 25)):
        name = rng.choice(["div", "b", "p", "i"])
        out.append(rng.choice([f"<{name}>", f"</{name}>", f"<{name}>", "<br>", "long text", "x", "</em>", f"<{name}>long</{name}>"]))
    return "".join(out)


def test_late_text_by_depth_is_that_read_in_turn(spark):
    rng = random.Random(3)
    pages = [(i, _random_page(rng)) for i in range(400)]
    tags, pairs, steps = F.col("tags"), F.col("pairs"), F.col("steps")
    found = (
        spark.createDataFrame(pages, "id long, page string")
        .withColumn("tags", H.tags(F.col("page")))
        .withColumn("pairs", H.tag_pairs(tags))
        .withColumn("steps", H.pair_steps(pairs))
        .withColumn("nested", matching_ends(steps))
        .withColumn("depths", H.tag_depths(tags, steps))
        .select(H.crossing(pairs, F.col("nested")).alias("crossing"), H.late_by_depth(tags, F.col("depths"), 4).alias("a"), H.late_in_turn(tags, 4).alias("b"))
        .collect()
    )
    assert all(r["a"] == r["b"] for r in found if not r["crossing"])
    assert 5 < sum(r["crossing"] for r in found) < 200 and sum(any(r["b"]) for r in found) > 50


def test_matching_ends(spark):
    events = [("a", 0, 1), ("b", 1, 1), ("a", 2, -1), ("b", 3, -1), ("a", 4, -1), ("a", 5, 1), ("c", 6, -1), ("a", 7, 1), ("a", 8, -1)]
    rows = spark.createDataFrame([(events,), ([],)], "e array<struct<name:string,place:int,step:bigint>>")
    found = [[tuple(x) for x in r["m"]] for r in rows.select(matching_ends(F.col("e")).alias("m")).collect()]
    assert found == [[(0, 2), (1, 3), (5, None), (7, 8)], []]


def test_nested_sections_take_their_links_from_within(spark):
    page = (
        "<section data-jobid=1><div><section data-jobid=2><p class=entry>ad</p><a href='/job/aaaaaaaa'>x</a></section>"
        "<section data-jobid=3><p>y</section></div></section><a href='/job/cccccccc'>out</a>"
        "<section data-jobid=4><section><p class=entry>in</p></section><section data-jobid=5>z</p><a href='/job/bbbbbbbb'>x</a>"
    )
    pages = spark.createDataFrame([("t", 1, page)], "search_term string, page_no int, html string")
    found = LK.listing_links(pages).orderBy("pos").collect()
    assert [(r["pos"], r["url"]) for r in found] == [(0, "/job/aaaaaaaa"), (1, None), (2, "/job/bbbbbbbb"), (3, "/job/bbbbbbbb")]


def test_scripts_and_comments_end_at_their_first_end(spark):
    """As the patterns that go on character by character find them; a page is searched once for its scripts."""
    code, script = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", r"(?is)<!--.*?-->|<script\b([^>]*)>(.*?)</script\s*>"
    data = "<SCRIPT type='application/ld+json' id=1>"
    pages = [
        f"a<!-->{data}x</script>-->b{data}{{1<2 <!-- }}</Script \n>c", f"{data}open <b>", f"<!-- - -- ->{data}</script>", f"{data}</script>{data}</scripts></script >",
        f"<style>{data}</style>a</script><script>x</style></script\t>b", f"{data}ä<\n-</script><!--->--><!----><scripts>z</scripts>", f"{data}" + "<-" * 50_000 + "</script>z",
        f"<!--{'-' * 50_000}>{data}y</script>", "", "<", "<script>", "<script type=application/ld+json></script>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, p string")
    found = df.select("i", H.strip_code(F.col("p")).alias("left"), H.json_scripts(F.col("p")).alias("scripts"))
    wanted = [(re.sub(code, "", p), [m[2] for m in re.finditer(script, p) if re.search("(?i)type='?application/ld.json", m[1] or "")]) for p in pages]
    assert [(r["left"], r["scripts"]) for r in found.orderBy("i").collect()] == wanted
    plan = df.select(H.json_scripts(F.col("p")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_clean_line_is_one_replacement(spark):
    lines = ["a b", " a  b ", "a1b", "a 1b", "a1 b", "1", " ", "  ", "", "ä-ß  ö", "a\tb\n c", "x" + " 1 " * 3 + "y"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    old = F.regexp_replace(F.regexp_replace("x", r"[^\p{L} ]", " "), " {2,}", " ")
    assert df.select(X.clean_line(F.col("x"))).collect() == df.select(old).collect()
    plan = df.select(X.clean_line(F.col("x")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
