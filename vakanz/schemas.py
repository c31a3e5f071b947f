"""Table layouts."""

from pyspark.sql import types as T


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

SECTION = _fields(heading=_S, content=_S)
LOCATION = _fields(latitude=_D, longitude=_D)
PAGES = _fields(page_id=_L, url=_S, html=_S)
POSTINGS = _fields(
    posting_id=_S,
    url=_S,
    title=_S,
    organization=_S,
    date_posted=T.DateType(),
    educational_requirements=_S,
    industry=_S,
    employment_type=_S,
    location=LOCATION,
    experience_requirements=_S,
    sections=T.ArrayType(SECTION),
)
PARAGRAPHS = _fields(
    posting_id=_S, paragraph_number=_I, paragraph_heading=_S, paragraph_content=_S
)
INTENT_TERMS = _fields(intent=_S, term=_S, d=_I, p=_I, w=_D)
REJECTS = _fields(stage=_S, key=_S, reason=_S)
POSTING_INDEX = _fields(
    posting_id=_S,
    url=_S,
    title=_S,
    organization=_S,
    educational_requirements=_S,
    employment_type=_S,
    industry=_S,
    experience_requirements=_S,
)

HEADING_TERMS = _fields(term=_S, posting_id=_S, paragraph_number=_I, tf=_I, length=_I)
VOCABULARY = _fields(term=_S, df=_L)
STATISTICS = _fields(postings=_L, paragraphs=_L, tokens=_L)

# Stored tables by stage.
STAGES = {
    "rejects/links": REJECTS,
    "rejects/postings": REJECTS,
    "rejects/counts": REJECTS,
    "requests": _fields(count=_L, page_no=_I, url=_S),
    "postings": POSTINGS,
    "index/postings": POSTING_INDEX,
    "index/paragraphs": PARAGRAPHS,
    "index/terms": HEADING_TERMS,
    "index/vocabulary": VOCABULARY,
    "index/statistics": STATISTICS,
}

# Stages whose rows have a fingerprint, and how many of its first characters make a range.
SLICED = {"postings": "posting_id"}
SLICE_CHARS = 1
