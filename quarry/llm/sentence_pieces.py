"""SentencePiece encoding and decoding by a shared-prefix forward search.

A batch of texts is normalised as the model says, its spaces become marks, and it falls into marked
words (a run of marks and what follows): no piece has a mark behind another character, so words
encode independently. The distinct words are sorted, which puts them in the order of a depth-first
walk of their trie, and the forward states of the prefix that a word shares with the one before are
kept, so each trie node is scored once.

*Unigram* models: the state of a node is the best score of a segmentation of its prefix and that
segmentation's last piece (Viterbi). *BPE* models: the segmentation with the largest sum of scores
isn't what merging gives, so there the state is the last piece of the prefix's encoding. It is the
one piece that follows the state where it starts in such a way that merging the two pieces' text
gives back the two pieces, so the same forward pass yields the merge result exactly. Words with
more than one mark in front are merged directly, since pieces of marks have equal scores; merging
takes the best pair from a heap, so a run of n marks takes n log n steps.

A character that no piece covers becomes its UTF-8 bytes' pieces (or the unknown piece). Decoding
gives the text back exactly unless it holds the mark character itself.

Nulls: a null text has no ids and decodes to null. An empty text has none and decodes to itself.
Repeated rows and ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import only, released, slices, table

MARK = "▁"
CACHE_CHARACTERS = 3_000_000  # of encoded words that a task keeps
CACHE_PAIRS = 200_000
BATCH_BYTES = 4 << 20
SHORT = 24
NO_PIECE = float("-inf")

NO_ID, START = 1 << 20, 1 << 22  # codes of characters without a piece, and of a word's start

_state: dict = {}
_pairs: dict[str, dict[int, bool]] = {}


class PieceModel:
    scored = 0  # trie nodes that got a state

    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        size = p.get_piece_size()
        self.ids = {p.id_to_piece(i): i for i in range(size) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}
        self.score = {piece: p.get_score(i) for piece, i in self.ids.items()}
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in range(size) if p.is_byte(i)}
        self.unknown = p.unk_id()
        # whole-number scores 0, -1, -2 ... are merge ranks
        self.merges = all(float(s).is_integer() for s in self.score.values())
        self.endings = set() if self.merges else {piece[k:] for piece in self.ids for k in range(len(piece))}
        self.backwards: dict = {}  # a trie of the pieces, read from their ends; "" has a piece's id
        for piece, i in self.ids.items() if self.merges else ():
            node = self.backwards
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = i
        self.pieces = {i: piece for piece, i in self.ids.items()}
        self.decoded = [b""] * size
        for piece, i in self.ids.items():
            self.decoded[i] = piece.replace(MARK, " ").encode()
        for value, i in self.bytes.items():
            self.decoded[i] = bytes([value])
        self.decoded[self.unknown] = "�".encode()
        self.words: dict[str, bytes] = {}
        self.held = 0  # characters of those words
        # whether two pieces stay apart, for as long as the worker lives; they depend on the model alone
        self.pairs: dict[int, bool] = _pairs.setdefault(path, {})

    def normalized(self, text: str) -> str:
        return self.processor.normalize(text)

    def merged(self, word: str) -> list[str]:
        """Merge by rank, the leftmost of equal ones first."""
        parts, score = list(word), self.score
        if len(parts) <= SHORT:  # where looking at all pairs is quicker than a heap
            while len(parts) > 1:
                ranks = [score.get(a + b, NO_PIECE) for a, b in zip(parts, parts[1:])]
                best = max(ranks)
                if best == NO_PIECE:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                joined = parts[i] + parts[j]
                s = score.get(joined)
                if s is not None:
                    heapq.heappush(heap, (-s, i, joined))

        for i in range(n):
            push(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if j >= n or not parts[i] or parts[i] + parts[j] != joined:
                continue  # one of the two has been merged since
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in parts if p]

    def code(self, piece: str) -> int:
        i = self.ids.get(piece)
        return i if i is not None else NO_ID + ord(piece)

    def text(self, code: int) -> str:
        return "" if code == START else chr(code - NO_ID) if code >= NO_ID else self.pieces[code]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the text of both gives both; at the start, whether right is whole."""
        a, b = self.text(left), self.text(right)
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def segment_merges(self, words: list[str]) -> list[list[str]]:
        """``segment`` of a model of merges: the state of a trie node is the code of its last piece."""
        out, before, scored = [], "", 0
        last = [START]
        pairs, follows, backwards, text = self.pairs, self.follows, self.backwards, self.text
        for word in words:
            if word.startswith(MARK + MARK):
                out.append(self.merged(word))
                continue
            shared, most = 0, min(len(word), len(before))  # the trie node where the two words part
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            scored += len(word) - shared
            for i in range(shared, len(word)):
                node, j, choice = backwards, i, NO_ID + ord(word[i])
                while j >= 0:
                    node = node.get(word[j])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is not None:
                        left = last[j]
                        apart = pairs.get(left << 32 | piece)
                        if apart is None:
                            apart = follows(left, piece)
                        if apart:
                            choice = piece
                            break
                    j -= 1
                last.append(choice)
            pieces, i = [], len(word)
            while i:
                piece = text(last[i])
                pieces.append(piece)
                i -= len(piece)
            out.append(pieces[::-1])
            before = word
        self.scored += scored
        return out

    def segment(self, words: list[str]) -> list[list[str]]:
        """The pieces of each word; ``words`` are sorted, so equal prefixes are neighbours."""
        if self.merges:
            return self.segment_merges(words)
        out = []
        last: list[str] = [""]  # of each prefix of the current path, its last piece
        best: list[float] = [0.0]
        before = ""
        score, endings = self.score, self.endings
        lowest = min(score.values(), default=0.0) - 10.0
        for word in words:
            shared, most = 0, min(len(word), len(before))  # the trie node where the two words part
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            self.scored += len(word) - shared
            for i in range(shared + 1, len(word) + 1):
                choice, value, found = word[i - 1], best[i - 1] + lowest, False
                for j in range(i - 1, -1, -1):
                    piece = word[j:i]
                    if piece not in endings:
                        break
                    s = score.get(piece)
                    if s is not None and (not found or best[j] + s > value):
                        choice, value, found = piece, best[j] + s, True
                last.append(choice)
                best.append(value)
            pieces, i = [], len(word)
            while i:
                pieces.append(last[i])
                i -= len(last[i])
            out.append(pieces[::-1])
            before = word
        return out

    def id_bytes(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for piece in pieces:
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in piece.encode())
            elif not (ids and ids[-1] == self.unknown):
                ids.append(self.unknown)
        return np.array(ids, dtype="<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = []
        for text in texts:
            line = self.normalized(text)
            parts = line.split(MARK)
            words = [MARK + x for x in parts[1:]]
            if parts[0]:
                words.insert(0, parts[0])
            if "" in parts[1:]:
                joined: list[str] = []
                run = ""
                for x in words:
                    if x == MARK:
                        run += MARK
                    else:
                        joined.append(run + x)
                        run = ""
                words = joined + [run] * bool(run)
            split.append(words)
        known = self.words
        if self.held > CACHE_CHARACTERS:
            known.clear()
            self.held = 0
        ordered = sorted({w for words in split for w in words if w not in known})
        for word, pieces in zip(ordered, self.segment(ordered)):
            known[word] = self.id_bytes(pieces)
            self.held += len(word)
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        decoded = self.decoded
        line = b"".join([decoded[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return line[1:] if line.startswith(" ") else line


def model(path: str) -> PieceModel:
    if _state.get("path") != path:
        _state.update(path=path, model=PieceModel(path))
    return _state["model"]


def _lists(coded: list[bytes | None]) -> pa.Array:
    """Ids as lists, from their bytes."""
    ends = np.cumsum([0, *(len(c or b"") // 4 for c in coded)], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(c or b"" for c in coded), "<i4")))
    return pa.array([None if c is None else x for c, x in zip(coded, lists.to_pylist())], lists.type) if None in coded else lists


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>)"""

    @released(__name__)
    def run(batches):
        for batch in slices(batches, most=BATCH_BYTES):
            texts = batch.column(1).to_pylist()
            coded = [None if t is None else c for t, c in zip(texts, model(path).encode([t or "" for t in texts]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(coded)], names=["doc_id", "ids"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)"""

    @released(__name__)
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                texts = [None if ids is None else model(path).decode(np.array(ids, "<i4")) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, ids array<int>, n_tokens, ids_crc32 (of the ids as
    little-endian 32-bit integers); ``exact`` tells whether the decoded text equals the text."""

    @released(__name__)
    def run(batches):
        for batch in slices(batches, most=BATCH_BYTES):
            texts = batch.column(1).to_pylist()
            coded = model(path).encode([t or "" for t in texts])
            back = [model(path).decode(np.frombuffer(c, "<i4")) for c in coded]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    _lists([None if t is None else c for t, c in zip(texts, coded)]),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                    pa.array([(t or "") == b for t, b in zip(texts, back)]),
                ],
                names=["doc_id", "ids", "n_tokens", "ids_crc32", "exact"],
            )

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, exact boolean")


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
