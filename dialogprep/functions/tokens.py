"""Tokenizers as Column -> Column functions.

A tokenizer here is any object with ``encode``, ``n_tokens`` and ``decode``
methods that map Columns to Columns, plus ``pad_token_id``, ``bos_token_id`` and
``eos_token_id``.  Two implementations:

* :class:`CodepointTokenizer` - one id per Unicode code point, written with
  native Spark expressions only, so it stays inside the JVM and can be checked
  against SQL.  Ids 0..15 are reserved for special tokens.
* :class:`PieceTokenizer` - any serialised ``tokenizers`` model, applied with an
  iterator Pandas UDF so the model is built once per Python worker stream and
  rows travel in Arrow batches.  The library gets a batch in calls of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDS_TYPE = T.ArrayType(T.IntegerType())

#: Characters or ids that go to a library in one call.  It holds some hundred
#: bytes for each token until the call returns, an Arrow batch has any size.
CALL_SIZE = 1 << 18


def _calls(sizes: list[int]) -> Iterator[slice]:
    """Consecutive slices of the rows, of ``CALL_SIZE`` in all at most or one row."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > CALL_SIZE:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _empty_ids() -> Column:
    return F.array().cast(IDS_TYPE)


class CodepointTokenizer:
    """id = code point + ``offset``; the first ``offset`` ids are specials.

    ``pad_id`` defaults to the EOS id, as in the reference's configuration
    (pad token set to the EOS token).
    """

    offset = 16
    special_names = ("<pad>", "<bos>", "<eos>") + tuple(
        f"<special_{i}>" for i in range(3, 16)
    )

    def __init__(self, pad_id: int | None = None):
        self.bos_token_id = 1
        self.eos_token_id = 2
        self.pad_token_id = self.eos_token_id if pad_id is None else pad_id

    # -- encode -----------------------------------------------------------
    def encode(self, text: Column, add_special: bool = False) -> Column:
        """Text -> ``array<int>``.  ``split(x, '')`` on '' gives [''], hence the guard."""
        off = self.offset
        ids = F.when(F.coalesce(text, F.lit("")) == "", _empty_ids()).otherwise(
            F.transform(F.split(text, ""), lambda c: F.ascii(c) + F.lit(off))
        )
        if add_special:
            ids = F.concat(F.array(F.lit(self.bos_token_id)), ids)
        return ids

    def n_tokens(self, text: Column, add_special: bool = False) -> Column:
        """Token count without building the array (one id per code point)."""
        n = F.length(F.coalesce(text, F.lit(""))).cast("int")
        return n + F.lit(1) if add_special else n

    # -- decode -----------------------------------------------------------
    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        """``array<int>`` -> text through one UTF-32 decode per row."""
        off = self.offset
        if skip_special:
            cps = F.transform(F.filter(ids, lambda i: i >= F.lit(off)), lambda i: i - F.lit(off))
        else:
            names = F.array(
                *[F.array(*[F.lit(ord(ch)) for ch in name]) for name in self.special_names]
            )
            cps = F.flatten(
                F.transform(
                    ids,
                    lambda i: F.when(i < F.lit(off), F.element_at(names, i + 1)).otherwise(
                        F.array(i - F.lit(off))
                    ),
                )
            )
        hexed = F.array_join(F.transform(cps, lambda c: F.lpad(F.hex(c), 8, "0")), "")
        return F.coalesce(F.decode(F.unhex(hexed), "UTF-32"), F.lit(""))


class PieceTokenizer:
    """Subword tokenizer from a serialised ``tokenizers`` JSON string.

    The JSON travels in the UDF closure; each Python worker builds the model once
    per partition stream (iterator UDF).  Special ids are looked up by name.
    """

    def __init__(self, tokenizer_json: str, bos: str = "<bos>", eos: str = "<eos>",
                 pad: str | None = None):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer_json)
        self._json = tokenizer_json
        self.bos_token_id = tok.token_to_id(bos)
        self.eos_token_id = tok.token_to_id(eos)
        self.pad_token_id = self.eos_token_id if pad is None else tok.token_to_id(pad)
        if self.bos_token_id is None or self.eos_token_id is None:
            raise ValueError("tokenizer lacks the bos/eos tokens")

    def _encode_udf(self, add_special: bool):
        spec, bos = self._json, self.bos_token_id

        @F.pandas_udf(IDS_TYPE)
        def encode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import numpy as np
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(spec)
            # Offsets are not needed: use the fast batch path when available.
            encode_batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
            head = [bos] if add_special else []
            for s in batches:
                all_texts = s.fillna("").tolist()
                for part in _calls([len(t) for t in all_texts]):
                    texts = all_texts[part]
                    encs = encode_batch(texts, add_special_tokens=False)
                    yield pd.Series(
                        [np.asarray(head + (e.ids if t else []), dtype=np.int32)
                         for e, t in zip(encs, texts)]
                    )
                    del encs  # before the next call

        return encode_batches

    def encode(self, text: Column, add_special: bool = False) -> Column:
        return self._encode_udf(add_special)(text)

    def n_tokens(self, text: Column, add_special: bool = False) -> Column:
        return F.size(self.encode(text, add_special))

    def _decode_udf(self, skip_special: bool):
        spec = self._json

        @F.pandas_udf(T.StringType())
        def decode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(spec)
            for s in batches:
                rows = s.tolist()
                for part in _calls([len(x) if x is not None else 0 for x in rows]):
                    yield pd.Series(
                        tok.decode_batch([[int(i) for i in x] if x is not None else [] for x in rows[part]],
                                         skip_special_tokens=skip_special)
                    )

        return decode_batches

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        return self._decode_udf(skip_special)(ids)


def byte_level_tokenizer_json(specials: tuple[str, ...] = ("<pad>", "<bos>", "<eos>")) -> str:
    """A byte-level BPE without merges: one token per UTF-8 byte.

    The vocabulary is built by rule - specials first, then byte ``b`` as id
    ``len(specials) + b``, spelled with the usual printable byte-to-character
    mapping of byte-level BPE - so no data or download is needed.  Useful as a
    subword-path stand-in whose counts are checkable (bytes + specials).
    """
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    printable = (list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1))
                 + list(range(ord("®"), ord("ÿ") + 1)))
    spelled, extra = {}, 0
    for b in range(256):
        if b in printable:
            spelled[b] = chr(b)
        else:
            spelled[b] = chr(256 + extra)
            extra += 1
    vocab = {s: i for i, s in enumerate(specials)}
    for b in range(256):
        vocab[spelled[b]] = len(specials) + b
    tok = Tokenizer(models.BPE(vocab=vocab, merges=[]))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tok.decoder = decoders.ByteLevel()
    tok.add_special_tokens(list(specials))
    return tok.to_str()
