"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, credentials, decontam, hosts, knn, langid, merkle, mixing, neardup, packing, revisit, spelling, toxicity

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_pack_tokens": packing.query,
    "op3_voronoi_topk": knn.query,
    "op4_host_reputation": hosts.query,
    "op5_toxicity_chain": toxicity.query,
    "op6_minhash_neardup": neardup.query,
    "op7_compression_langid": langid.query,
    "op8_revisit_resolution": revisit.query,
    "op9_benchmark_decontam": decontam.query,
    "op10_secret_scan": credentials.query,
    "op11_merkle_manifest": merkle.query,
    "op12_chat_format": chat.query,
    "op13_spelling_variants": spelling.query,
}
ORACLE = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_voronoi_topk": knn.ORACLE,
    "op4_host_reputation": hosts.ORACLE,
    "op6_minhash_neardup": neardup.ORACLE,
    "op8_revisit_resolution": revisit.ORACLE,
    "op9_benchmark_decontam": decontam.ORACLE,
    "op10_secret_scan": credentials.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_chat_format": chat.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
