"""Explicit schemas of the flat tables; nothing is inferred."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType,
)


def _of(**fields) -> StructType:
    return StructType([StructField(k, t, True) for k, t in fields.items()])


_S, _I, _L, _D, _B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()
ARGUMENT = _of(text=_S, mention_id=_S)

TOKENS = _of(doc_id=_S, t_id=_I, sent_id=_I, number=_I, token=_S)
MARKABLES = _of(doc_id=_S, m_id=_S, tag=_S, anchors=ArrayType(_I), related_to=_S, tag_descriptor=_S, instance_id=_S)
RELATIONS = _of(doc_id=_S, r_id=_S, kind=_S, note=_S, sources=ArrayType(_S), target=_S)
MENTIONS = _of(
    doc_id=_S, sent_id=_I, tokens_number=ArrayType(_I), tokens_str=_S, mention_type=_S, coref_chain=_S,
    is_continuous=_B, is_singleton=_B, score=_D, is_person=_B,
)
EVENT_ARGUMENTS = _of(mention_id=_S, arg0=ARGUMENT, arg1=ARGUMENT, amtmp=ARGUMENT, amloc=ARGUMENT)
ROLES = _of(event_id=_S, entity_id=_S, role=_S)
SRL = _of(doc_id=_S, sent_id=_I, tok_id=_I, predicate=_S, arg_info=MapType(_S, ArrayType(_I)))
PAIRS = _of(topic=_S, m1_doc=_S, m1_sent=_I, m1_str=_S, m2_doc=_S, m2_sent=_I, m2_str=_S, scope=_S, seq=_I, label=_I)
VOTES = _of(pair_id=_L, template=_S, correct=_I, valid=_I, repeat=_I)
SPANS = _of(topic=_I, doc_name=_S, entity_num=_I, sentence_num=_I, start_token=_I, end_token=_I, cluster_id=_I)
SPAN_PAIRS = _of(topic=_I, entity_num_1=_I, entity_num_2=_I, label=_I, pred_proba=_D)
SELECTED = _of(topic=_I, file=_S, sentence=_I)
V1_MENTIONS = _of(
    doc_id=_S, topic=_I, subtopic=_S, m_id=_S, sentence_id=_I, tokens_ids=ArrayType(_I), tokens=_S, tags=_S, lemmas=_S,
    cluster_id=_L, cluster_desc=_S,
)
GOLD_CONLL = V1_MENTIONS
CHAINS = _of(doc=_S, begin=_I, end=_I, chain=_S)
