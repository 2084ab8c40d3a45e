"""N-best segmentation into the pieces of a SentencePiece vocabulary, and decoding.

The lattice of a text has an edge for every piece that matches, weighted by the piece's score, and one in bytes for
every character that no piece covers. Forward Viterbi scores are exact heuristics for an A* search from the end back, which so
yields segmentations best first. No piece goes on past a word's end, so a text's lattice is its words' lattices in a
row: words are searched by themselves and remembered, and a text's N best choices differ from its best only
in the N-1 words that lose least by their second choice.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of

SPACE = "▁"
#: Stands for a space mark that the text itself has; no piece matches it.
_LITERAL = "\U0010fffe"
N_BEST = 4
#: A character in bytes scores this much below the lowest piece, as the library's unknown pieces do.
UNKNOWN_PENALTY = 10.0
NEVER = -1e8
_KEPT = 500_000


class Vocabulary:
    """The pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        pieces = [model.id_to_piece(i) for i in range(size)]
        scores = {p: (i, model.get_score(i)) for i, p in enumerate(pieces) if p and not special[i]}
        self.unknown = min(s for _, s in scores.values() if s > NEVER) - UNKNOWN_PENALTY
        # Some models give pieces of last resort a score that stands for none; they count as unknown characters do.
        self.pieces = {p: (i, s if s > NEVER else self.unknown) for p, (i, s) in scores.items()}
        self.automaton = ahocorasick.Automaton()
        for p, (i, score) in self.pieces.items():
            self.automaton.add_word(p, (len(p), (i,), score))
        self.automaton.make_automaton()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.plain = [b"" if s else p.replace(SPACE, " ").encode() for p, s in zip(pieces, special, strict=True)]
        for b, i in enumerate(self.byte_ids):
            self.plain[i] = bytes([b])
        inside = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.words = re.compile("(?s).+" if inside else f"(?s){SPACE}*[^{SPACE}]+|{SPACE}+")
        self.new: dict[str, tuple[bytes, float, float, int]] = {}
        self.old: dict[str, tuple[bytes, float, float, int]] = {}
        self.ranked: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def edges(self, word: str) -> Iterator[tuple[int, int, tuple[int, ...], float]]:
        """The edges (start, end, ids, score) of a word's lattice by their ends."""
        bare = [k for k, c in enumerate(word) if c not in self.pieces]
        matches = ((end + 1 - n, end + 1, ids, score) for end, (n, ids, score) in self.automaton.iter(word))
        if not bare:
            return matches
        raw = [{_LITERAL: SPACE, SPACE: " "}.get(word[k], word[k]).encode() for k in bare]
        in_bytes = [(k, k + 1, tuple(self.byte_ids[b] for b in r), self.unknown * len(r)) for k, r in zip(bare, raw, strict=True)]
        return heapq.merge(matches, in_bytes, key=lambda edge: edge[1])

    def best_two(self, word: str) -> tuple[bytes, float, float, int]:
        """The best segmentation's ids (little-endian, 32 bits), its score, what the second best loses, and its number of pieces."""
        n = len(word)
        first, second, back = [0.0] + [-np.inf] * n, [-np.inf] * (n + 1), [None] * (n + 1)
        for edge in self.edges(word):
            i, j, _, weight = edge
            s = first[i] + weight
            if s > first[j]:
                first[j], second[j], back[j] = s, first[j], edge
            elif s > second[j]:
                second[j] = s
            if (s := second[i] + weight) > second[j]:
                second[j] = s
        parts, j = [], n
        while j:
            parts.append(back[j][2])
            j = back[j][0]
        ids = [x for part in reversed(parts) for x in part]
        return pack(f"<{len(ids)}I", *ids), first[n], first[n] - second[n], len(ids)

    def n_best(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """The n best (score, ids) of a word, best first; of equal scores, what the search finds first.

        The agenda holds partial segmentations from the end back as links to what they go on from, so their length costs nothing."""
        ends: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(len(word) + 1)]
        forward = [0.0] + [-np.inf] * len(word)
        for i, j, ids, s in self.edges(word):
            ends[j].append((i, ids, s))
            forward[j] = max(forward[j], forward[i] + s)
        # (estimate, place, order of making): of equal estimates the one nearest to the beginning goes first.
        agenda: list[tuple[float, int, int, float, tuple | None]] = [(-forward[-1], len(word), 0, 0.0, None)]
        out: list[tuple[float, bytes]] = []
        taken, made = [0] * (len(word) + 1), 0
        while agenda and len(out) < n:
            _, at, _, done, chain = heapq.heappop(agenda)
            if not at:
                ids, link = [], chain
                while link:
                    ids.extend(link[0])
                    link = link[1]
                out.append((done, pack(f"<{len(ids)}I", *ids)))
                continue
            # With exact heuristics, no more than the n best rests from a place are part of the n best.
            if taken[at] == n:
                continue
            taken[at] += 1
            for start, piece, s in ends[at]:
                made += 1
                heapq.heappush(agenda, (-(done + s + forward[start]), start, made, done + s, (piece, chain)))
        return out

    def split(self, text: str) -> list[str]:
        """A text's words in the vocabulary's writing, the first space added; no words for an empty text."""
        if not text:
            return []
        return self.words.findall(SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE))

    def look_up(self, words: list[str]) -> list[tuple[bytes, float, float, int]]:
        if len(self.new) > _KEPT:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, words))
        if None in found:
            for k in [k for k, x in enumerate(found) if x is None]:
                w = words[k]
                if (x := self.new.get(w)) is None:
                    x = self.old.get(w) or self.best_two(w)
                    if len(w) < 64:
                        self.new[w] = x
                found[k] = x
        return found

    def segment(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text, best first: (score, ids). The words that lose least by their second choice give all
        their choices by the A* search, the others their best."""
        words = self.split(text)
        best = self.look_up(words)
        ids = [x[0] for x in best]
        total = sum(x[1] for x in best)
        weak = [k for k in heapq.nsmallest(n - 1, range(len(words)), key=lambda k: best[k][2]) if best[k][2] < np.inf] if n > 1 else []
        choices = [self.choices(words[k], n) for k in weak]
        for k, c in zip(weak, choices, strict=True):
            ids[k] = c[0][1]
        out, seen = [], set()
        agenda: list[tuple[float, tuple[int, ...]]] = [(0.0, (0,) * len(weak))]
        while agenda and len(out) < n:
            lost, pick = heapq.heappop(agenda)
            if pick in seen:
                continue
            seen.add(pick)
            own = ids
            if any(pick):
                own = ids.copy()
                for k, c, p in zip(weak, choices, pick, strict=True):
                    own[k] = c[p][1]
            out.append((total - lost, b"".join(own)))
            for k, p in enumerate(pick):
                if p + 1 < len(choices[k]):
                    heapq.heappush(agenda, (lost + choices[k][p + 1][0] - choices[k][p][0], (*pick[:k], p + 1, *pick[k + 1 :])))
        return out

    def choices(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """(what is lost against the best, ids) of a word's n best segmentations; short words' are remembered."""
        if (found := self.ranked.get((word, n))) is None:
            own = self.n_best(word, n)
            found = [(own[0][0] - s, i) for s, i in own]
            if len(word) < 64:
                if len(self.ranked) > _KEPT // 4:
                    self.ranked = {}
                self.ranked[word, n] = found
        return found

    def decode(self, ids: bytes) -> str:
        """The text of ids, the added first space left out."""
        raw = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.removeprefix(b" ").decode(errors="replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


# ---------------------------------------------------------------- operator


def encode_n_best(docs: DataFrame, model_path: str, n: int = N_BEST) -> DataFrame:
    """doc_id, text and segmentations: an array, best first, of score and ids (binary: little-endian, 32 bits each).

    Null and empty texts have the one empty segmentation with score 0; rows with repeated or null ids are segmented one by
    one; other columns are not read. Texts with few choices have fewer than ``n``. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model_path)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                found = [[{"score": s, "ids": i} for s, i in v.segment(t, n)] for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "text": part["text"].to_numpy(), "segmentations": found})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(run, "doc_id long, text string, segmentations array<struct<score:double,ids:binary>>")


def decode(rows: DataFrame, ids: str, model_path: str) -> DataFrame:
    """``rows`` with decoded, the text of the ids in binary column ``ids`` (null for null)."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        v = vocabulary(model_path)
        return pd.Series([None if x is None else v.decode(x) for x in column], dtype=object)

    return rows.withColumn("decoded", run(F.col(ids)))


def digest_n_best(docs: DataFrame, model_path: str, n: int = N_BEST) -> DataFrame:
    """doc_id, n_pieces, score, ids_crc32, round_trip, n_found, n_best: of the best segmentation its size, score and
    checksum, and whether decoding it gives the text; of all their scores, sizes and checksums in a line each. What
    encode_n_best and decode give, digested in one pass so that no ids leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model_path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                found = v.segment(text, n)
                lines = [f"{s:.3f}:{len(i) // 4}:{zlib.crc32(i)}" for s, i in found]
                score, ids = found[0]
                rows.append((doc_id, len(ids) // 4, score, zlib.crc32(ids), v.decode(ids) == text, len(found), "\n".join(lines)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_pieces", "score", "ids_crc32", "round_trip", "n_found", "n_best"])
            if len(out):
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(run, "doc_id long, n_pieces long, score double, ids_crc32 long, round_trip boolean, n_found int, n_best string")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_n_best_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The N best segmentations of all of ``documents``; see digest_n_best."""
    return digest_n_best(read_table(spark, sf_dir, "documents"), piece_model_path())


QUERIES = {"op2_n_best_segmentation": op2_n_best_segmentation}
ORACLE_SQL: dict[str, str] = {}
