"""Token-id array functions (Column -> Column), all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogprep.functions.tokens import IDS_TYPE
from dialogprep.schema import IGNORE_INDEX

# Fixed values of the portable array checksum (same formula in the SQL oracle).
CHECKSUM_BASE = 31
CHECKSUM_MOD = 1000003


def target_ids(target_text: Column, tokenizer) -> Column:
    """Ids of a non-empty target followed by EOS; [] for '' or null."""
    t = F.coalesce(target_text, F.lit(""))
    return F.when(t == "", F.array().cast(IDS_TYPE)).otherwise(
        F.concat(tokenizer.encode(t), F.array(F.lit(tokenizer.eos_token_id)))
    )


def concat_ids(source: Column, target: Column) -> Column:
    """C4: input ids = source ++ target."""
    return F.concat(source, target)


def masked_labels(source: Column, target: Column) -> Column:
    """``[-100] * len(source) ++ target``."""
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size(source)), target)


def unmask_labels(labels: Column, pad_id: int) -> Column:
    """Replace the ignore sentinel by the pad id (for display)."""
    return F.transform(labels, lambda x: F.when(x == IGNORE_INDEX, F.lit(pad_id)).otherwise(x))


def full_labels(ids: Column) -> Column:
    """TAPT labels are a copy of the ids (nothing masked)."""
    return ids


def ones_mask(ids: Column) -> Column:
    """Attention mask of ones."""
    return F.array_repeat(F.lit(1), F.size(ids))


def continuation(out_ids: Column, prompt_ids: Column) -> Column:
    """``out[len(prompt):]`` - the generated part only."""
    n = F.size(prompt_ids)
    return F.slice(out_ids, n + 1, F.greatest(F.size(out_ids) - n, F.lit(0)))


def as_long(ids: Column) -> Column:
    """int64 ids at the sink."""
    return ids.cast("array<bigint>")


def checksum(ids: Column) -> Column:
    """Order-sensitive polynomial checksum of an id array (bigint)."""
    return F.aggregate(
        F.coalesce(ids, F.array().cast(IDS_TYPE)),
        F.lit(0).cast("bigint"),
        lambda z, x: (z * CHECKSUM_BASE + x) % CHECKSUM_MOD,
    )
