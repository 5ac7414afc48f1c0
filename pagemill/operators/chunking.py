"""Chunkers whose next boundary depends on the one before: generators over a text, run on Arrow batches.

Each maps (doc_id, text) to chunks. A document is cut in one pass; documents are independent, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.batches import parts

# Places to break, best first.
SEPARATORS = ["\n\n", "。\n", "\n", "。", "！", "？", ". ", "! ", "? "]
RETRIEVAL_SEPARATORS = ["\n\n", "。", ". ", "；", "; ", "\n"]

#: Tokens a character below which a text is not taken to be.
LEAST_RATIO = 0.3

Span = tuple[int, int]


def last_break(text: str, start: int, end: int, separators: list[str]) -> int:
    """Behind the last occurrence of the best separator in a stretch, or -1."""
    for s in separators:
        if (at := text.rfind(s, start, end)) >= 0:
            return at + len(s)
    return -1


def by_characters(text: str, size: int = 8000, overlap: int = 500, separators: list[str] = SEPARATORS, legacy_tail: bool = True) -> Iterator[Span]:
    """Chunks of up to ``size`` characters, broken at a separator in their last ``overlap`` characters.

    Each begins ``overlap`` before the last one's end. With ``legacy_tail`` a last chunk that lies inside its predecessor comes too.
    """
    if len(text) <= size:
        yield 0, len(text)
        return
    at, began = 0, None
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text) and (cut := last_break(text, max(at, end - overlap), end, separators)) > at:
            end = cut
        if text[at:end].strip():
            yield at, end
            began = at
        if end == len(text) and not legacy_tail:
            return
        following = end - overlap
        at = end if began is not None and following <= began else max(following, at + 1)


def by_tokens(text: str, estimate: Callable[[str], int], most: int = 6000, overlap: int = 300, separators: list[str] = SEPARATORS, reach: int = 500) -> Iterator[Span]:
    """Chunks of up to ``most`` estimated tokens, broken at a separator in their last ``reach`` characters.

    Sizes follow from the text's own tokens a character, taken to be LEAST_RATIO at least.
    """
    total = estimate(text)
    if total <= most:
        yield 0, len(text)
        return
    ratio = max(total / len(text), LEAST_RATIO)
    size, back = int(most / ratio), int(overlap / ratio)
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end > at + 500 and estimate(text[at:end]) > most:
            end = at + int((end - at) * 0.8)
        if end < len(text) and (cut := last_break(text, max(at, end - reach), end, separators)) > at + 200:
            end = cut
        if text[at:end].strip():
            yield at, end
        at = end if end - back <= at else end - back


def sliding(text: str, size: int = 12000, overlap: int = 2000, separators: list[str] = RETRIEVAL_SEPARATORS) -> Iterator[Span]:
    """Chunks broken in their second half; the last one ends the text, without a redundant tail."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text) and (cut := last_break(text, at + size // 2, end, separators)) > 0:
            end = cut
        yield at, end
        if end >= len(text):
            return
        at = max(end - overlap, at + 1)


def token_estimate(text: str) -> int:
    """The same estimate as functions.text.token_estimate."""
    import regex

    if not text:
        return 0
    wide = regex.findall(r"[一-鿿㐀-䶿]", text)
    words = len(regex.sub(r"[一-鿿㐀-䶿]", "", text).split())
    signs = len(regex.findall(r"[^\p{L}\p{N}_\s\p{Z}]", text))
    return max(1, int(len(wide) * 1.8 + words * 1.3 + signs * 0.5))


def _cut(batches: Iterator[pa.RecordBatch], spans: Callable[[str], Iterator[Span]]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += [(doc, k, (text or "")[a:b].strip(), a, b, token_estimate((text or "")[a:b].strip())) for k, (a, b) in enumerate(spans(text or ""))]
        columns = zip(*rows) if rows else [()] * 6
        kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "chunk", "text", "start_pos", "end_pos", "est_tokens"])


def chunks(docs: DataFrame, spans: Callable[[str], Iterator[Span]] = by_characters) -> DataFrame:
    """(doc_id, chunk, text, start_pos, end_pos, est_tokens); an empty text is one empty chunk with ``by_characters``."""
    return docs.select("doc_id", "text").mapInArrow(partial(_cut, spans=spans), "doc_id long, chunk int, text string, start_pos int, end_pos int, est_tokens int")


def chunker(mode: str, **options) -> Callable[[str], Iterator[Span]]:
    """The chunker of a mode: chars, tokens (the default of the configuration) or sliding."""
    return partial(*{"chars": (by_characters,), "tokens": (by_tokens, ), "sliding": (sliding,)}[mode], **({"estimate": token_estimate} if mode == "tokens" else {}), **options)
