"""Token counts without encoding whole texts: words proven offline to be one token are counted directly."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from kinelane.llm.common import arrow_pass, text_of
from kinelane.llm.units import UnitCache, piece_units

SPACE = "▁"


def load_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def cuts_at_spaces(model) -> bool:
    """True if no piece holds a space after another character, so that no merge crosses the start of a word."""
    return not any(SPACE in model.id_to_piece(i).lstrip(SPACE) for i in range(model.get_piece_size()) if not _special(model, i))


def _special(model, i: int) -> bool:
    return model.is_control(i) or model.is_unknown(i) or model.is_byte(i)


def whole_words(model) -> dict[str, int]:
    """The proof: words ``w`` whose piece (space + w) the library gives back as that one token when it encodes ``w``.

    The vocabulary is the only input, so this is done once per worker, apart from any text. A piece that merges into
    something else (or is reached by no merge) fails the proof and is left to be merged.
    """
    pieces = {i: model.id_to_piece(i) for i in range(model.get_piece_size()) if not _special(model, i)}
    words = {i: p[1:] for i, p in pieces.items() if p.startswith(SPACE) and len(p) > 1 and SPACE not in p[1:]}
    coded = model.encode(list(words.values()), num_threads=1)
    return {w: 1 for (i, w), ids in zip(words.items(), coded, strict=True) if ids == [i]}


class Counter:
    """Counts of a piece model for one worker process."""

    def __init__(self, path: str):
        self.model = load_pieces(path)
        self.cuts = cuts_at_spaces(self.model)
        self.counts = UnitCache(self._merge, whole_words(self.model))

    def _merge(self, units: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(units, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return self._merge(texts)
        split = [piece_units(t.replace(SPACE, " ")) if t else [] for t in texts]
        self.counts.fill(split)
        return [sum(map(self.counts.__getitem__, units)) for units in split]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``df``, without begin, end or added special tokens.

    One pass, no shuffle. The cache of merged units is bounded; a text of any length is read whole. Null text counts as
    empty (0 bytes, 0 tokens); null ids, repeated rows and an empty table pass through row by row; other columns are
    not read, so their names cannot clash.
    """

    def work(rows: dict[str, list]) -> dict[str, object]:
        n = counter(path).count(rows["text"])
        return {"doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in rows["text"]], "n_tokens": n, "over_limit": [k > limit for k in n]}

    kind = df.schema[id_column].dataType.simpleString()
    slim = df.select(df[id_column].alias("doc_id"), text_of(text_column).alias("text"))
    return arrow_pass(slim, work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
