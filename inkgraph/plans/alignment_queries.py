"""Foreign token lists at their places in the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgraph.operators import alignment
from inkgraph.plans import adapters as ad


def foreign_lists(s, d):
    """Words and marks of documents as another tokenizer might give them: every seventh lower-cased, every ninth as a piece with ## before it."""
    found = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"), F.lit(1))
    changed = F.transform(found, lambda t, i: F.when(i % 9 == 4, F.concat(F.lit("##"), t)).when(i % 7 == 3, F.lower(t)).otherwise(t))
    return ad.table(s, d, "documents").select("doc_id", changed.alias("tokens"))


def aligned(s, d):
    return alignment.align_tokens(ad.table(s, d, "documents"), foreign_lists(s, d))


QUERIES = {
    "tokens_aligned": aligned,
    "tokens_alignment_report": lambda s, d: alignment.alignment_report(aligned(s, d)),
}

#: SQL needs one step of a recursion over the rest of a text for each token, which is too slow on whole tables; a plain search in the tests stands for it.
ORACLE_SQL: dict[str, str] = {}
