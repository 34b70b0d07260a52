"""The queries of the training-data operators."""

from __future__ import annotations

from conceptloom.llm.chat import op7_chat_events
from conceptloom.llm.hilbert import op1_hilbert_shards
from conceptloom.llm.licenses import op9_license_join
from conceptloom.llm.mixing import op6_entropy_mix
from conceptloom.llm.multiset import op10_multiset_fingerprints
from conceptloom.llm.oracle import chat_sql, license_sql
from conceptloom.llm.packing import op3_lexical_packing
from conceptloom.llm.quality import op4_pairwise_quality
from conceptloom.llm.simhash import op5_simhash_balls
from conceptloom.llm.telephony import op8_telephony_audio
from conceptloom.llm.toxicity import op2_toxic_neighbours

QUERIES = {
    f.__name__: f
    for f in (
        op1_hilbert_shards, op2_toxic_neighbours, op3_lexical_packing, op4_pairwise_quality, op5_simhash_balls, op6_entropy_mix, op7_chat_events, op8_telephony_audio,
        op9_license_join, op10_multiset_fingerprints,
    )
}

#: SQL can express none of the others whole: they need crc32 or xxhash64, Newton steps, models or tokenizers.
ORACLE_SQL: dict[str, str] = {"op7_chat_events": chat_sql(), "op9_license_join": license_sql()}
