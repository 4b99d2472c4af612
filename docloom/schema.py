"""Schemas of the engine's tables."""

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
_SS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_RAW = dict(id=_L, court=_S, date=_S, title=_S, case_number=_S, text=_S, hashtags=_SS, articles=_SS, source_channel=_S)
RAW = _struct(**_RAW)
SECTIONS = _struct(fabula=_S, lower_courts=_S, vs_position=_S, residual=_S)
LEMMAS = _struct(title=_SS, fabula=_SS, lower_courts=_SS, vs_position=_SS, full=_SS, tags=_SS)
DOCS = _struct(doc_idx=_L, **_RAW, iso_date=_S, year=_I, case_id=_S, case_ids=_SS, sections=SECTIONS, lemmas=LEMMAS)
EMBEDDINGS = _struct(doc_id=_L, embedding=T.ArrayType(T.FloatType()))
QUERIES = _struct(query_id=_L, query=_S, court=_S, tag=_S, article=_S, year_from=_I, year_to=_I, limit=_I, deduplicate=_B, vector=T.ArrayType(T.FloatType()))
