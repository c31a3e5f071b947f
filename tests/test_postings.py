import json

from pyspark.sql import functions as F

from vakanz.operators import links as LK
from vakanz.operators import postings as P
from vakanz.operators import sections as S
from vakanz.plans import jobs
from vakanz.runtime import accepted, rejects

LONG = "ein langer satz mit vielen worten"


def sections(spark, *descriptions):
    df = spark.createDataFrame(list(enumerate(descriptions)), "i int, d string")
    rows = S.with_sections(df, "d").orderBy("i").collect()
    return [[(s["heading"], s["content"]) for s in row["sections"]] for row in rows]


def part(heading, *lines, tag="b"):
    return f"<{tag}>{heading}</{tag}>" + "".join(f"<p>{line}</p>" for line in lines)


def test_heading_length_and_tags(spark):
    five, six, most, over = "Abcde", "Abcdef", "A" * 39, "A" * 40
    found = sections(
        spark, part(five, LONG), part(six, LONG), part(most, LONG), part(over, LONG),
        part("Aufgaben", LONG, tag="h1"), part("Aufgaben", LONG, tag="strong"),
        f"<span style='font-weight:bold'>Aufgaben</span><p>{LONG}</p>",
        f"<b>abc</b><span style='font-size: 14px'>Aufgaben</span><p>{LONG}</p>",
    )
    assert [bool(f) for f in found] == [False, True, True, False, False, True, True, True]
    assert found[5] == [("aufgaben", LONG)]


def test_last_section_keeps_ten_rows(spark):
    lines = [f"zeile {chr(97 + i) * 20}" for i in range(12)]
    for n, kept in ((9, 9), (10, 10), (11, 10)):
        ((_, content),) = sections(spark, part("Aufgaben", *lines[:n]))[0]
        assert content == " ".join(lines[:kept])


def test_order_is_by_rows_and_next_heading_ends_a_section(spark):
    text = part("Kurzes", LONG) + part("Laengeres", LONG + " b", LONG + " c") + part("Ende sechs")
    assert [h for h, _ in sections(spark, text)[0]] == ["laengeres", "kurzes"]
    early = f"<p>Zweite</p>{part('Erste', LONG)}{part('Zweite', LONG)}"
    assert [h for h, _ in sections(spark, early)[0]] == ["zweite"]


def test_same_clean_heading_keeps_first_place_and_later_content(spark):
    text = part("Aufgaben:", *[LONG + c for c in "abcde"]) + part("Mitte sechs", *[LONG] * 4)
    text += part("Aufgaben", LONG + " x", LONG + " y", LONG + " z")
    names = sections(spark, text)[0]
    assert [h for h, _ in names] == ["aufgaben", "mitte sechs"]
    assert names[0][1] == f"{LONG} x {LONG} y {LONG} z"


def test_longest_line(spark):
    found = sections(spark, part("Aufgaben", "a" * 20), part("Aufgaben", "a" * 21))
    assert [len(f) for f in found] == [0, 1]


def test_rows_without_text_of_their_own(spark):
    late = "<p><i>ab</i>text nach dem kind</p>"
    inner = "<p><i>kursiv</i> und text</p>"
    found = sections(
        spark,
        # counts as a row, so the first section is the longer one
        part("Erste Punkte", LONG) + late + part("Zweite Punkte", LONG),
        part("Zweite Punkte", LONG, LONG + " b") + part("Erste Punkte", LONG) + late * 2 + part("Schluss"),
        # the tenth row of the last section may be one without text
        part("Letzte", *[LONG] * 9) + late + f"<p>{LONG} mehr</p>",
        # a heading without text ends the section before it at the first such row
        part("Anfang", LONG) + inner + f"<p>{LONG} b</p><b><i>x</i>Titel danach</b><p>{LONG} c</p>",
        # a text in front of the child is the first text
        part("Anfang", LONG) + f"<p>kurz<br>{LONG} d</p><p>a<i>bc</i>{LONG} e</p>",
    )
    assert [h for h, _ in found[0]] == ["erste punkte", "zweite punkte"]
    assert [h for h, _ in found[1]] == ["erste punkte", "zweite punkte"]
    assert found[2] == [("letzte", " ".join([LONG] * 9))]
    assert found[3] == [("anfang", LONG)]
    assert found[4] == [("anfang", f"{LONG} kurz")]


def test_line_breaks_are_removed(spark):
    assert sections(spark, f"<b>Auf\r\ngaben</b><p>{LONG}\n</p>")[0] == [("aufgaben", LONG)]


def record(pad=0, **fields):
    return json.dumps({"pad": "x" * pad, **fields}, ensure_ascii=False)


def script(text):
    return f'<script type="application/ld+json">{text}</script>'


def sized(size, **fields):
    return record(size - len(record(0, **fields)), **fields)


def test_choice_of_structured_data(spark):
    geo = {"g": "GeoCoordinates"}
    pages = [
        "",
        script(sized(1999)), script(sized(2000)), script(sized(2001)),
        script(sized(2000)) + script(record(**geo)), script(sized(2001)) + script(record(**geo)),
        script(sized(2001)) + script(record()), script(sized(2001, **geo)) + script(record(**geo)),
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    from vakanz.functions import html as H

    chosen = H.let(H.json_scripts(F.col("html")), P.structured_data)
    rows = df.select("i", chosen.alias("c")).orderBy("i").collect()
    assert [r["c"]["kind"] for r in rows] == [
        "html", "html", "none", "json", "none", "json", "none", "json",
    ]
    assert rows[5]["c"]["json"] == record(**geo) and rows[7]["c"]["json"] == sized(2001, **geo)


DESCRIPTION = part("Ihre Aufgaben", LONG) + part("Ihr Profil", LONG, LONG)
FULL = dict(
    url="https://X.example.org/1", title="Leiter IT", datePosted="2018-07-15",
    industry=["IT/Software", "Bank"], employmentType=["FULL_TIME"],
    hiringOrganization={"name": "Firma AG"}, experienceRequirements="Zwei Jahre",
    jobLocation=[{"geo": {"latitude": 48.1, "longitude": 11.5}}], description=DESCRIPTION,
)


def pages_frame(spark):
    pages = [
        (1, script(sized(2500, **FULL))),
        (2, script(sized(2600, **FULL))),
        (3, script(sized(2500, **{**FULL, "description": part("Ihre Aufgaben", LONG)}))),
        (4, script("{broken" + " " * 2000)),
        (5, script(sized(2000))),
        (6, '<div class="a maincontent b">nur text</div>'),
        (7, script(sized(2500, title="ohne Text"))),
        (8, script(sized(2500, **{**FULL, "description": DESCRIPTION + "<p>mehr Text</p>"}))),
        (9, script(sized(2500, **{**FULL, "jobLocation": "Ulm", "industry": "IT"}))),
    ]
    return spark.createDataFrame(pages, "page_id long, html string")


def test_parse_and_reject(spark):
    tagged = P.parse_postings(pages_frame(spark))
    good = {r["page_id"]: r for r in accepted(tagged).collect()}
    assert sorted(good) == [1, 2, 8, 9]
    first = good[1]
    assert (first["url"], first["title"], first["organization"]) == (
        "https://x.example.org/1", "leiter it", "firma ag",
    )
    assert first["industry"] == "it software,bank" and first["employment_type"] == "full_time"
    assert str(first["date_posted"]) == "2018-07-15" and tuple(first["location"]) == (48.1, 11.5)
    assert [s["heading"] for s in first["sections"]] == ["ihr profil", "ihre aufgaben"]
    assert good[9]["location"] is None and good[9]["industry"] == "it"
    bad = {r["key"]: r["reason"] for r in rejects(tagged, "postings", "page_id").collect()}
    assert bad == {
        "3": "fewer than two sections",
        "4": "malformed structured data",
        "5": "no usable structured data",
        "6": "fewer than two sections",
        "7": "no description",
    }


def test_distinct_postings(spark):
    unique = P.distinct_postings(accepted(P.parse_postings(pages_frame(spark))))
    assert sorted(r["page_id"] for r in unique.collect()) == [1, 8, 9]
    shuffled = pages_frame(spark).orderBy(F.desc("page_id")).repartition(3)
    again = P.distinct_postings(accepted(P.parse_postings(shuffled)))
    ids = lambda df: {(r["page_id"], r["posting_id"]) for r in df.collect()}
    assert ids(unique) == ids(again)


def test_listing_links(spark):
    html = (
        '<section data-jobid="1"><a href="/job/aaaaaaaaa1">x</a></section>'
        "<section data-jobid='2'><p class='entry'>ad</p><a href='/job/aaaaaaaaa2'>x</a></section>"
        "<section data-jobid='3'><div><p class='entry'>no ad</p></div><a href=/job/aaaaaaaaa3>x</a></section>"
        '<section data-jobid="4"><p>nothing</p></section>'
        '<section data-jobid="5"><a href="/job/none">x</a></section>'
        '<section><a href="/job/aaaaaaaaa6">x</a></section>'
        "<section data-jobid=7><img src=a><p>t</p><p class=entry>ad</p><a href='/job/aaaaaaaaa7'>x</a></section>"
        "<section data-jobid=8><a href='/job/AAAAAAAAA1'>x</a></section>"
    )
    pages = spark.createDataFrame(
        [("it", 1, html), ("it", 2, '<section data-jobid="1"><a href="/other/aaaaaaaaa1">x</a></section>')],
        "search_term string, page_no int, html string",
    )
    tagged = LK.listing_links(pages)
    assert sorted((r["page_no"], r["url"]) for r in accepted(tagged).collect()) == [
        (1, "/job/AAAAAAAAA1"), (1, "/job/aaaaaaaaa1"), (1, "/job/aaaaaaaaa3"), (2, "/other/aaaaaaaaa1"),
    ]
    unique, bad = jobs.gather_links(pages)
    assert sorted(r["url"] for r in unique.collect()) == [
        "/job/AAAAAAAAA1", "/job/aaaaaaaaa1", "/job/aaaaaaaaa3",
    ]
    assert sorted(r["reason"] for r in bad.collect()) == ["no job id in link", "no link in section"]
    once = LK.first_per_id(unique, ["search_term"], ["page_no", "pos"])
    assert once.count() == unique.count()


def test_listing_of_nested_sections_and_open_paragraphs(spark):
    html = (
        "<section data-jobid='1'><section class='inner'><p>x</p></section><a href='/job/aaaaaaaaa1'>x</a></section>"
        "<section data-jobid='2'><p>a<p class='entry'>ad</p><a href='/job/aaaaaaaaa2'>x</a></section>"
        "<section data-jobid='3'><p>a<div><p>b<p class='entry'>no ad</div><a href='/job/aaaaaaaaa3'>x</a></section>"
        "<section data-jobid='4'><section data-jobid='5'><a href='/job/aaaaaaaaa5'>x</a></section></section>"
        "<section data-jobid='6'></section>"
    )
    pages = spark.createDataFrame([("it", 1, html)], "search_term string, page_no int, html string")
    rows = LK.listing_links(pages).orderBy("pos").collect()
    assert [r["url"] and r["url"][-1] for r in rows] == ["1", "3", "5", "5", None]


def test_comments_and_scripts(spark):
    good = script(sized(2500, **FULL))
    pages = [
        (1, f"<!-- {script('{}')} -->{good}"),
        (2, f"<script>a='<!--'</script>{good}<script>b='-->'</script>"),
        (3, f"<script>'<!--'</script><div class='maincontent'><b>Ihre Aufgaben</b></div><script>'-->'</script>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    assert [r["page_id"] for r in accepted(P.parse_postings(df)).orderBy("page_id").collect()] == [1, 2]
    from vakanz.functions import html as H

    assert "Aufgaben" in df.where("page_id = 3").select(H.strip_code(F.col("html"))).first()[0]


def test_the_last_of_repeated_keys_counts(spark):
    twice = record(2500, **FULL).replace('"title": "Leiter IT"', '"title": "Erster", "title": "Zweiter"')
    df = spark.createDataFrame([(1, script(twice))], "page_id long, html string")
    assert accepted(P.parse_postings(df)).first()["title"] == "zweiter"


def test_time_grows_with_the_page(spark):
    import time

    def took(kind, n):
        if kind == "headings":
            html = "".join(f"<b>Kopf {i:05d}</b><p>{LONG} {i}</p>" for i in range(n))
            work = S.with_sections(spark.createDataFrame([(1, html)], "i int, d string"), "d").select(F.size("sections"))
        else:
            html = "<section data-jobid=1>" + "<div><p class='entry'>x</p></div>" * n + "<a href='/job/aaaaaaaaa1'></a></section>"
            frame = spark.createDataFrame([("t", 1, html)], "search_term string, page_no int, html string")
            work = LK.listing_links(frame).select("pos")
        start = time.perf_counter()
        assert len(work.collect()) == 1
        return time.perf_counter() - start

    for kind in ("headings", "entries"):
        took(kind, 500)
        assert took(kind, 16_000) < 6 * took(kind, 4_000) + 1
