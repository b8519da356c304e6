"""Token counts of sections and fields, by offsets.

A document is encoded once, as a whole. Tokens and sections are both ordered ranges of the document's
bytes, so one merge gives every token to the section it lies in. A token that crosses a boundary goes
by an explicit rule:

    start   to the section of its first byte
    end     to the section of its last byte
    most    to the section that holds most of its bytes; of equals, the first
    share   to each section in proportion to its bytes
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.arrow import batch_of, columns, map_batches, text_of
from spanloom.llm.bpe import encoder, tokenizer_path
from spanloom.llm.hashing import groups

RULES = ("start", "end", "most", "share")


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and tokens that reach over its end.

    ends: where tokens end; they lie in a row from 0. bounds: where sections end, likewise; both end
    at the same place. An empty section gets no token.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    start = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    by_end = np.searchsorted(ends, bounds, "right")  # tokens that end within or at the bound
    by_start = np.searchsorted(start, bounds, "left") if len(ends) else np.zeros(len(bounds), np.int64)
    crossing = by_start - by_end  # 1 where a token begins before the bound and ends after it
    if rule == "start":
        upto = by_start.astype(float)
    elif rule == "end":
        # the last byte decides: a token that crosses belongs to a later section
        upto = by_end.astype(float)
    else:
        upto = by_end.astype(float)
        at = np.flatnonzero(crossing)
        token = by_end[at]
        if rule == "share":
            upto[at] += (bounds[at] - start[token]) / (ends[token] - start[token])
        else:
            # sections that a token touches: from the one of its first byte to the one of its last
            for t in np.unique(token).tolist():
                s = at[token == t]
                cut = np.concatenate([[start[t]], bounds[s], [ends[t]]])
                best = int(np.argmax(np.diff(cut)))
                upto[s[best:]] += 1
    return np.diff(np.concatenate([[0], upto])), crossing


def token_ends(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of all tokens of texts in a row, and tokens of each text."""
    enc = encoder(path)
    if enc.byte_level:
        ids, counts = enc.encode(texts)
        return np.cumsum(enc.id_bytes[ids]), counts
    out, base, counts = [], 0, []
    for t, e in zip(texts, enc.tok.encode_batch(texts, add_special_tokens=False), strict=True):
        width = np.concatenate([[0], np.cumsum([len(c.encode()) for c in t])])
        end = np.array([b for _, b in e.offsets], np.int64)
        end = width[end]
        if len(end):
            end = np.maximum.accumulate(end)
            end[-1] = width[-1]  # what the tokenizer drops at the end belongs to the last token
        out.append(end + base)
        base += int(width[-1])
        counts.append(len(end))
    return np.concatenate(out or [np.zeros(0, np.int64)]), np.array(counts, np.int64)


def line_ends(raw: bytes) -> np.ndarray:
    """Ends of the lines (with their line feed) of a text; an empty text is one line."""
    feed = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return feed if len(feed) and feed[-1] == len(raw) else np.append(feed, len(raw))


def section_tokens(docs: DataFrame, *, rule: str = "most", tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, start, end (code points), n_tokens, crosses, doc_tokens: a row for each line.

    A line ends with its line feed. The tokens of a document's lines add up to ``doc_tokens``.
    ``crosses`` counts the tokens that reach over the line's end. Null and empty texts are one empty
    line; repeated rows stay; an empty table gives no rows; other columns aren't read.
    """
    path = tokenizer or tokenizer_path()
    names = ["doc_id", "section", "start", "end", "n_tokens", "crosses", "doc_tokens"]
    kinds = [pa.int64()] * 4 + [pa.float64() if rule == "share" else pa.int64()] + [pa.int64()] * 2
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, all_texts = columns(b, "k", "text")
            for lo, hi in groups(all_texts):
                keys, texts = every[lo:hi], all_texts[lo:hi]
                raws = [t.encode() for t in texts]
                lines = [line_ends(r) for r in raws]
                many = np.array([len(x) for x in lines])
                doc = np.repeat(np.arange(len(texts)), many)
                base = np.cumsum([0] + [len(r) for r in raws[:-1]])
                bounds = np.concatenate(lines) + base[doc]
                ends, counts = token_ends(texts, path)
                n, crosses = attribute(ends, bounds, rule)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(b"".join(raws), np.uint8) & 0xC0) != 0x80)])
                begin = np.concatenate([[0], bounds[:-1]])
                first = np.cumsum(many) - many
                yield batch_of(schema, doc_id=pa.array(keys, pa.int64()).take(pa.array(doc)), section=np.arange(len(doc)) - first[doc], start=chars[begin] - chars[base[doc]], end=chars[bounds] - chars[base[doc]], n_tokens=n if rule == "share" else n.astype(np.int64), crosses=crosses, doc_tokens=counts[doc])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_of(text_col).alias("text"))
    kind = "double" if rule == "share" else "long"
    return map_batches(rows, run, f"doc_id long, section long, start long, end long, n_tokens {kind}, crosses long, doc_tokens long")


def field_tokens(rows: DataFrame, fields: list[str], *, separator: str = "\n", rule: str = "most", tokenizer: str | None = None) -> DataFrame:
    """``rows`` with ``tokens_<field>`` for each text field and ``tokens_all``.

    The fields are joined by ``separator`` and encoded once; a separator belongs to the field before
    it. Null fields count as empty.
    """
    path = tokenizer or tokenizer_path()
    new = [f"tokens_{f}" for f in fields] + ["tokens_all"]
    if clash := set(new) & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType() if rule == "share" and n != "tokens_all" else T.LongType()) for n in new)])
    kinds = [pa.float64() if rule == "share" else pa.int64()] * len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(zip(*([x or "" for x in c] for c in columns(b, *fields)), strict=True))
            whole = [separator.join(t) for t in texts]
            ends, counts = token_ends(whole, path)
            size = [len(x.encode()) + (len(separator.encode()) if k < len(fields) - 1 else 0) for t in texts for k, x in enumerate(t)]
            n, _ = attribute(ends, np.cumsum(size), rule) if size else (np.zeros(0), None)
            table = n.reshape(-1, len(fields))
            cols = [b.column(c) for c in kept] + [pa.array(table[:, k]).cast(kind) for k, kind in enumerate(kinds)] + [pa.array(counts)]
            yield pa.RecordBatch.from_arrays(cols, names=kept + new)

    return map_batches(rows, run, schema)
