"""HTML as arrays of start tags, read with expressions only.

An element is represented by its start tag, its attribute text and the text between the start
tag and the next tag. Quoted attribute values may hold ``<`` and ``>``.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakanz.functions.arrays import BLOCK, following, last_of_each, let, matching_ends, running_sums

# Attribute text: quoted values are skipped as a whole. Possessive, so that long or broken
# attributes cannot make the matcher backtrack.
_ATTRS = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
START_TAG = rf"<([a-zA-Z][a-zA-Z0-9]*+)({_ATTRS})>([^<]*)"
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?"""
QUOTES = r"""^["']|["']$"""
TAG = rf"<(/?)([a-zA-Z][a-zA-Z0-9]*+)({_ATTRS})>([^<]*)"
# A comment may hold scripts and a script comments: whichever starts first counts. Both run up to the
# first end; the matcher goes from one ``-`` or ``<`` to the next, not character by character.
_COMMENT = r"!--[^-]*(?:-(?!->)[^-]*)*+-->"
COMMENT_OR_CODE = rf"(?i)<(?:{_COMMENT}|(script|style)\b[^>]*>[^<]*(?:<(?!/\1\s*>)[^<]*)*+</\1\s*>)"
COMMENT_OR_SCRIPT = rf"(?i)<(?:{_COMMENT}|script\b[^>]*>[^<]*(?:<(?!/script\s*>)[^<]*)*+</script\s*>)"
LD_JSON = r"""(?i)(?:^|\s)type\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json(?:\s|$))"""

# Elements without content; text after them belongs to the surrounding element.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
)

# Named entities of the HTML standard that end in a semicolon, most frequent ones first.
FREQUENT = ("amp", "lt", "gt", "quot", "nbsp", "auml", "ouml", "uuml", "szlig", "eacute")
ENTITIES = {n.removesuffix(";"): c for n, c in html5.items() if n.endswith(";")}


def _code_point(number: str) -> str:
    """SQL for the character of a code point; out-of-range numbers give NULL."""
    return (
        f"CASE WHEN {number} BETWEEN 1 AND {0xD7FF} OR {number} BETWEEN {0xE000} AND {0x10FFFF} "
        f"THEN decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32') END"
    )


def _reference_sql() -> str:
    """SQL for what the reference ``n``, without ``&`` and ``;``, stands for; NULL when it is none."""
    table = json.dumps(ENTITIES).replace("'", "\\u0027")
    frequent = " ".join(f"WHEN n = '{name}' THEN r'{ENTITIES[name]}'" for name in FREQUENT)
    decimal = _code_point("CAST(conv(substring(n, 2, 7), 10, 10) AS BIGINT)")
    hexadecimal = _code_point("CAST(conv(substring(n, 3, 6), 16, 10) AS BIGINT)")
    return (
        f"CASE WHEN n = '' THEN NULL {frequent} WHEN NOT startswith(n, '#') "
        f"THEN try_element_at(from_json(r'{table}', 'map<string,string>'), n) "
        f"WHEN n RLIKE '^#[0-9]{{1,7}}$' THEN {decimal} "
        f"WHEN n RLIKE '^#[xX][0-9A-Fa-f]{{1,6}}$' THEN {hexadecimal} END"
    )


# One pass over the parts between ampersands; written as SQL, which is one step to build.
_DECODE = (
    "t -> CASE WHEN contains(t, '&') THEN array_join(transform(split(t, '&', -1), (p, i) -> "
    "CASE WHEN i = 0 THEN p ELSE coalesce(get(transform("
    "array(regexp_extract(p, '^(#?[A-Za-z0-9]{1,32});', 1)), "
    f"n -> concat({_reference_sql()}, substring(p, length(n) + 2, length(p)))), 0), concat('&', p)) END), '') "
    "ELSE t END"
)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references to characters, in one pass from left to right."""
    return F.get(F.call_function("transform", F.array(text), F.expr(_DECODE)), F.lit(0))


def strip_code(page: Column) -> Column:
    """Page without comments, scripts and style sheets."""
    return F.regexp_replace(page, COMMENT_OR_CODE, "")


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute, quoted or bare, entities decoded; NULL when it is absent.

    An attribute without a value is an empty string.
    """
    names = F.transform(F.regexp_extract_all(attrs, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(attrs, F.lit(ATTRIBUTE), F.lit(2))
    place = F.array_position(names, F.lit(name)).cast("int")
    raw = F.get(values, F.nullif(place, F.lit(0)) - 1)
    return let(raw, lambda v: decode_entities(F.regexp_replace(v, QUOTES, "")))


def nodes(page: Column, with_attrs: bool = False) -> Column:
    """``array<struct<tag,text>>`` of all elements in document order, on request with ``attrs``.

    Text in front of the first tag becomes a paragraph of its own, as HTML parsers make it.
    """
    groups = [(1, "tag"), (3, "text")] + ([(2, "attrs")] if with_attrs else [])
    parts = F.arrays_zip(
        *[F.regexp_extract_all(page, F.lit(START_TAG), F.lit(g)).alias(name) for g, name in groups]
    )
    lead = {"tag": F.lit("p"), "text": F.regexp_extract(page, r"^[^<]+", 0), "attrs": F.lit("")}
    first = F.array(F.struct(*[lead[name].alias(name) for _, name in groups]))
    none = F.slice(first, F.lit(1), F.lit(0))

    def element(node: Column) -> Column:
        tag = F.lower(node["tag"])
        own = F.when(tag.isin(*VOID_TAGS), F.lit("")).otherwise(decode_entities(node["text"]))
        extra = [node["attrs"].alias("attrs")] if with_attrs else []
        return F.struct(tag.alias("tag"), own.alias("text"), *extra)

    leading = F.when(F.startswith(page, F.lit("<")), none).otherwise(first)
    return F.transform(F.concat(leading, parts), element)


_REFERENCE = "&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
_OPEN_ELEMENTS = "array<struct<at:int,tag:string,seen:boolean>>"


def may_have_late_text(page: Column) -> Column:
    """Cheap test: some tag directly follows another, and text follows an end or void tag."""
    void = "|".join(VOID_TAGS)
    tail = rf"(?i)<(?:/[a-z]|(?:{void})\b)[^<>]*>[^<]{{4}}"
    return F.contains(page, F.lit("><")) & F.regexp_like(page, F.lit(tail))


def tags(page: Column) -> Column:
    """``array<struct<place,step,tag,attrs,text>>`` of all tags, names in lower case.

    ``step`` is 1 at start tags, -1 at end tags, 0 at void ones.
    """
    groups = ((1, "slash"), (2, "tag"), (3, "attrs"), (4, "text"))
    found = F.arrays_zip(*[F.regexp_extract_all(page, F.lit(TAG), F.lit(g)).alias(name) for g, name in groups])

    def numbered(t: Column, place: Column) -> Column:
        name = F.lower(t["tag"])
        step = F.when(t["slash"] == "/", -1).when(name.isin(*VOID_TAGS), 0).otherwise(1).cast("bigint")
        return F.struct(place.alias("place"), step.alias("step"), name.alias("tag"), t["attrs"].alias("attrs"), t["text"].alias("text"))

    return F.transform(found, numbered)


# The parts of late text are columns of their own (``operators.sections.with_text_nodes``): they are
# evaluated once each, and no expression is nested deeper than the analyzer follows.


def tag_pairs(all_tags: Column) -> Column:
    """``array<struct<place,end>>`` of the start tags that have an end tag of their name."""
    named = F.filter(all_tags, lambda t: t["step"] != 0)
    events = F.transform(named, lambda t: F.struct(t["tag"].alias("name"), t["place"].alias("place"), t["step"].alias("step")))
    return F.filter(matching_ends(events), lambda p: p["end"].isNotNull())


def pair_steps(pairs: Column) -> Column:
    """Starts and ends of pairs as ``struct<name,place,step>``, in any order."""
    step = lambda at, n: lambda p: F.struct(F.lit("").alias("name"), p[at].alias("place"), F.lit(n).cast("bigint").alias("step"))
    return F.concat(F.transform(pairs, step("place", 1)), F.transform(pairs, step("end", -1)))


def crossing(pairs: Column, by_depth: Column) -> Column:
    """Whether some pair begins in another one and ends behind it: depth (``by_depth``) matches them otherwise."""
    same = F.zip_with(by_depth, pairs, lambda x, y: F.coalesce(x["end"] == y["end"], F.lit(False)))
    return F.exists(same, lambda x: ~x)


def tag_depths(all_tags: Column, steps: Column) -> Column:
    """The number of open pairs behind each tag."""
    none = F.lit(0).cast("bigint")
    rows = F.concat(
        F.transform(all_tags, lambda t: F.struct(t["place"].alias("place"), F.lit(0).alias("paired"), none.alias("step"))),
        F.transform(steps, lambda s: F.struct(s["place"].alias("place"), F.lit(1).alias("paired"), s["step"].alias("step"))),
    )

    def summed(rows: Column) -> Column:
        sums = running_sums(F.transform(rows, lambda r: r["step"]))
        return F.zip_with(rows, sums, lambda r, depth: F.struct(r["place"].alias("place"), depth.alias("depth")))

    return F.transform(let(let(F.array_sort(rows), summed), lambda r: last_of_each(r, "place")), lambda r: r["depth"])


def late_by_depth(all_tags: Column, depths: Column, min_length: int) -> Column:
    """For each start tag, whether its first text comes after a child and is long enough.

    Text behind an end or void tag belongs to the innermost open element. Elements and such texts
    are sorted by depth and place: each text then follows the element it belongs to. An element
    that is never closed ends with the pair around it. For pages whose pairs do not cross.
    """

    def item(tag: Column, depth: Column) -> Column:
        starts = tag["step"] > 0
        return F.when(starts | (tag["text"] != ""), F.struct(
            depth.alias("depth"), tag["place"].alias("place"), starts.alias("starts"),
            F.when(starts, tag["text"] == "").otherwise(_long(tag["text"], min_length)).alias("wanted"),
        ))

    def late(x: Column, y: Column) -> Column:
        found = x["wanted"] & (x["depth"] == y["depth"]) & ~y["starts"] & y["wanted"]
        return F.when(x["starts"], F.struct(x["place"].alias("place"), F.coalesce(found, F.lit(False)).alias("late")))

    items = F.filter(F.zip_with(all_tags, depths, item), lambda x: x.isNotNull())
    own = F.filter(let(F.array_sort(items), lambda i: following(i, late)), lambda x: x.isNotNull())
    void = F.transform(F.filter(all_tags, lambda t: t["step"] == 0), lambda t: F.struct(t["place"].alias("place"), F.lit(False).alias("late")))
    return F.transform(F.array_sort(F.concat(own, void)), lambda x: x["late"])


def _long(text: Column, min_length: int) -> Column:
    return F.length(F.regexp_replace(text, _REFERENCE, "x")) >= min_length


def late_text_elements(page: Column, min_length: int) -> Column:
    """Numbers of the start tags whose first text comes after a child and is long enough, as found."""
    return let(tags(page), lambda all_tags: _found_in_turn(all_tags, min_length))


def late_in_turn(all_tags: Column, min_length: int) -> Column:
    """``late_by_depth`` for any page."""
    starts = F.filter(all_tags, lambda t: t["step"] >= 0)
    flag = lambda at, late: F.struct(at.cast("int").alias("at"), F.lit(late).alias("late"))
    found = F.transform(_found_in_turn(all_tags, min_length), lambda i: flag(i, True))
    rows = F.concat(F.transform(starts, lambda t, i: flag(i, False)), found)
    return let(F.array_sort(rows), lambda r: F.transform(last_of_each(r, "at"), lambda x: x["late"]))


def _found_in_turn(all_tags: Column, min_length: int) -> Column:
    """Late elements with the open ones as state; an end tag closes the innermost open element of its name.

    Found elements are gathered in blocks, so the state holds the open elements only.
    """

    def state(at: Column, elements: Column, found: Column) -> Column:
        return F.struct(at.alias("at"), elements.alias("open"), found.alias("found"))

    def text_after(at: Column, elements: Column, found: Column, text: Column) -> Column:
        top = F.try_element_at(elements, F.lit(-1))
        others = F.slice(elements, F.lit(1), F.greatest(F.size(elements) - 1, F.lit(0)))
        marked = F.struct(top["at"].alias("at"), top["tag"].alias("tag"), F.lit(True).alias("seen"))
        first = (text != "") & F.coalesce(~top["seen"], F.lit(False))
        longer = F.when(_long(text, min_length), F.array_append(found, top["at"])).otherwise(found)
        return F.when(first, state(at, F.array_append(others, marked), longer)).otherwise(state(at, elements, found))

    def step(acc: Column, item: Column) -> Column:
        opened = F.struct(acc["at"].alias("at"), item["tag"].alias("tag"), (item["text"] != "").alias("seen"))
        names = F.reverse(F.transform(acc["open"], lambda e: e["tag"]))
        place = F.array_position(names, item["tag"]).cast("int")
        left = F.when(place > 0, F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - place)).otherwise(acc["open"])
        closed = let(left, lambda e: text_after(acc["at"], e, acc["found"], item["text"]))
        void = text_after(acc["at"] + 1, acc["open"], acc["found"], item["text"])
        return (
            F.when(item["step"] < 0, closed)
            .when(item["step"] == 0, void)
            .otherwise(state(acc["at"] + 1, F.array_append(acc["open"], opened), acc["found"]))
        )

    none = F.array().cast("array<int>")

    def block(acc: Column, number: Column) -> Column:
        part = F.slice(all_tags, number * BLOCK + 1, F.lit(BLOCK))
        read = F.aggregate(part, state(acc["at"], acc["open"], none), step)
        return let(read, lambda r: state(r["at"], r["open"], F.array_append(acc["found"], r["found"])))

    start = state(F.lit(0), F.array().cast(_OPEN_ELEMENTS), F.array().cast("array<array<int>>"))
    blocks = F.sequence(F.lit(0), F.floor(F.size(all_tags) / F.lit(BLOCK)).cast("int"))
    return F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["found"]))


def json_scripts(page: Column) -> Column:
    """Texts of the structured-data scripts of a page, in document order; the page is searched once."""
    found = F.regexp_extract_all(page, F.lit(COMMENT_OR_SCRIPT), F.lit(0))
    start = lambda s: F.substring_index(s, ">", 1)
    attrs = lambda s: F.regexp_extract(start(s), r"(?is)^<script\b(.*)$", 1)
    chosen = F.filter(found, lambda s: F.regexp_like(attrs(s), F.lit(LD_JSON)))

    def text(script: Column) -> Column:
        # The start and end tags go, with the bracket that the parts beside them were cut at.
        begin = F.length(start(script)) + 1
        return F.substring(script, begin + 1, F.length(script) - begin - F.length(F.substring_index(script, "<", -1)) - 1)

    return F.transform(chosen, text)


def text_content(fragment: Column) -> Column:
    """All text of a fragment, tags removed and entities decoded."""
    return decode_entities(F.regexp_replace(fragment, rf"</?[a-zA-Z]{_ATTRS}>", ""))


def element_body(page: Column, tag: str, class_pattern: str) -> Column:
    """Inner HTML of the first ``tag`` whose class matches; NULL when there is none.

    The end is the matching end tag: the pieces between start and end tags of the same name
    carry +1 or -1, and the body ends where the running sum first falls below its begin.
    """
    head = rf"""(?is)<{tag}\b[^<>]*?\sclass\s*=\s*(?:"[^"]*?{class_pattern}[^"]*"|'[^']*?{class_pattern}[^']*')[^<>]*>"""
    rest = F.element_at(F.split(page, head, 2), 2)
    pieces = F.split(rest, rf"(?i)(?=</?{tag}\b)")
    step = lambda piece: (
        F.when(F.regexp_like(piece, F.lit(rf"(?i)^</{tag}\b")), -1).when(F.regexp_like(piece, F.lit(rf"(?i)^<{tag}\b")), 1).otherwise(0)
    )

    def inner(parts: Column) -> Column:
        end = F.array_position(running_sums(F.transform(parts, lambda p: step(p).cast("bigint"))), F.lit(-1).cast("bigint")).cast("int")
        return F.array_join(F.slice(parts, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(parts))), "")

    return F.when(F.regexp_like(page, F.lit(head)), let(pieces, inner))
