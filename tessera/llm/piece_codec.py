"""SentencePiece encoding and decoding for merge-type vocabularies (operator 4).

Encoding keeps an agenda of adjacent symbol pairs whose concatenation is a
piece, ordered by score and then by position from the left; the best pair is
merged and its new neighbours join the agenda until none is left.  Symbols
that are no piece become byte pieces.  No piece of such a vocabulary holds a
space mark after another character, so merges never cross the start of a run
of space marks, and a character that is in no longer piece stands alone.
Texts are therefore cut there and the parts are encoded one by one, with a
bounded memo per worker.  A vocabulary without that property is not cut there.
Parts are cut once more, into runs, between characters that no piece holds
side by side.

The unseen parts of a batch are merged together.  Runs of one symbol count
are the rows of a matrix, and so are the agendas of their pairs' ranks; a
round merges the best pair of every row, which leaves rows of one symbol less
that join the runs of that count.  Symbols are integers.  Runs above
``ROW_CHARS`` characters keep their agenda as a heap.

Every Arrow batch is checked against the sentencepiece library; column
``agrees`` holds the outcome per row.

Defined results: a null text is empty and has the begin and end ids alone;
repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import whole_text

SPACE = "▁"
#: Parts whose ids a worker remembers at a time, twice over, and their longest.
MEMO = 200_000
MEMO_CHARS = 64
#: Longest run that is a row of a matrix; longer ones have a heap of their own.
ROW_CHARS = 32
#: Characters of the texts that are cut and merged together (or one text).
CHUNK_CHARS = 1 << 18
#: Place of a pair that is no piece, behind all others.
NO_PIECE = (1 << 31) - 1
#: Bits of a symbol in the number of a pair.
SYMBOL_BITS = 24


class HashedCodes:
    """Places of distinct non-negative 64-bit codes, looked up in arrays: a
    slot read or two instead of a binary search."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(4 * max(len(codes), 1) - 1).bit_length())
        self.codes = np.full(1 << self.bits, -1, np.int64)
        self.places = np.full(1 << self.bits, -1, np.int32)
        self.reach = 0
        left, slots = np.arange(len(codes)), self._slots(codes)
        while len(left):
            at = (slots + self.reach) & (len(self.codes) - 1)
            # the first of those that meet at a free slot takes it
            at, first = np.unique(at, return_index=True)
            won = first[self.codes[at] < 0]
            at = (slots[won] + self.reach) & (len(self.codes) - 1)
            self.codes[at], self.places[at] = codes[left[won]], left[won]
            left, slots = np.delete(left, won), np.delete(slots, won)
            self.reach += 1

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of codes, -1 for those that are not there."""
        shape, codes = codes.shape, codes.ravel()
        at = self._slots(codes)
        found = self.codes[at]
        out = np.where(found == codes, self.places[at], np.int32(-1))
        # a code moves on only past a slot that another code holds
        open_ = np.flatnonzero((found != codes) & (found >= 0))
        for step in range(1, self.reach):
            if not len(open_):
                break
            at_next = (at[open_] + step) & (len(self.codes) - 1)
            found = self.codes[at_next]
            hit = found == codes[open_]
            out[open_[hit]] = self.places[at_next[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out.reshape(shape)


class PieceCodec:
    """Vocabulary of a model file with its merge agenda."""

    def __init__(self, path: str, memo: int = MEMO):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.pieces: list[bytes] = []
        self.byte_values: dict[int, int] = {}
        self.hidden: set[int] = set()
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            self.pieces.append(piece.replace(SPACE, " ").encode())
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.byte_values[i] = value
            elif lib.is_control(i):
                self.hidden.add(i)
            elif lib.is_unknown(i):
                self.pieces[i] = " ⁇ ".encode()
            else:
                self.ids[piece] = i
                self.scores[piece] = lib.get_score(i)
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        #: bytes of every id; control ids have none
        self.table = [bytes((self.byte_values[i],)) if i in self.byte_values else
                      b"" if i in self.hidden else piece for i, piece in enumerate(self.pieces)]
        #: the same bytes in one array, with every id's start and length
        self.table_bytes = np.frombuffer(b"".join(self.table), np.uint8)
        self.table_lengths = np.fromiter(map(len, self.table), np.int64, len(self.table))
        self.table_starts = np.cumsum(self.table_lengths) - self.table_lengths
        self.prefixed = lib.normalize("x")[:1] == SPACE
        self.byte_fallback = len(self.byte_values) == 256
        better = sorted(set(self.scores.values()), reverse=True)
        place = {score: r for r, score in enumerate(better)}
        #: place of a piece's score, best first; equal scores share one
        self.ranks = {piece: place[score] for piece, score in self.scores.items() if len(piece) > 1}
        #: pairs of characters that some piece holds side by side
        self.adjacent = {p[i:i + 2] for p in self.ranks for i in range(len(p) - 1)}
        self.memo, self.known, self.former = memo, {}, {}
        self._tables(place)
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        joined = set().union(*(p for p in self.ids if len(p) > 1))
        #: characters that stand alone, if texts may be cut by replacements
        self.alone = None if whole else [c for c in "\n\t\r" if c not in joined]
        alone = "".join(map(re.escape, self.alone or ""))
        self.parts = re.compile("(?s).+" if whole else
                                (f"[{alone}]|" if alone else "")
                                + f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+")

    def _tables(self, place: dict[float, int]) -> None:
        """Symbols as integers: a piece is its id, a character that is no piece
        stands behind all ids.  Sorted numbers of the pairs of symbols that
        join to a piece, with the piece's rank and id; sorted numbers of the
        pairs of characters of ``adjacent``."""
        self.first_char = len(self.pieces)
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.first_char
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i

        def symbol(s: str) -> int | None:
            return int(self.symbol_of[ord(s)]) if len(s) == 1 else self.ids.get(s)

        joins = {}
        for piece in self.ranks:
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    joins[left << SYMBOL_BITS | right] = (place[self.scores[piece]], self.ids[piece])
        codes = sorted(joins)
        # one entry behind the last, so that every search ends inside the table
        self.pair_codes = np.array([*codes, -1], dtype=np.int64)
        self.pair_codes[-1] = np.iinfo(np.int64).max
        self.pair_ranks = np.array([*(joins[c][0] for c in codes), NO_PIECE], dtype=np.int32)
        self.pair_ids = np.array([*(joins[c][1] for c in codes), 0], dtype=np.int64)
        self.pair_places = HashedCodes(self.pair_codes[:-1])
        self.side_by_side = HashedCodes(np.array(
            [ord(a) << SYMBOL_BITS | ord(b) for a, b in self.adjacent], dtype=np.int64))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table of pairs and whether the pair is there."""
        at = self.pair_places.find(left << SYMBOL_BITS | right)
        return at, at >= 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, there = self._pairs(left, right)
        return np.where(there, self.pair_ranks[at], np.int32(NO_PIECE))

    def merge_rows(self, symbols: np.ndarray, starts: np.ndarray,
                   lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge runs of at most ``ROW_CHARS`` symbols, given by their starts
        and lengths in ``symbols``.  Returns, for every symbol count that is
        left, the numbers of its runs and their symbols as a matrix."""
        done = []
        runs, rows = np.empty(0, np.int64), np.empty((0, 0), np.int64)
        agenda = np.empty((0, 0), np.int32)
        for n in range(int(lengths.max(initial=0)), 0, -1):
            fresh = np.flatnonzero(lengths == n)
            if len(fresh):
                new = symbols[starts[fresh][:, None] + np.arange(n)]
                new_agenda = self._ranks(new[:, :-1], new[:, 1:])
                if len(runs):
                    runs, rows = np.concatenate([runs, fresh]), np.concatenate([rows, new])
                    agenda = np.concatenate([agenda, new_agenda])
                else:
                    runs, rows, agenda = fresh, new, new_agenda
            if not len(runs):
                continue
            if n == 1:
                done.append((runs, rows))
                break
            left = agenda.argmin(axis=1)
            open_ = agenda[np.arange(len(runs)), left] != NO_PIECE
            if not open_.all():
                done.append((runs[~open_], rows[~open_]))
                runs, rows, agenda, left = runs[open_], rows[open_], agenda[open_], left[open_]
            m = len(runs)
            at = np.arange(m)
            place, _ = self._pairs(rows[at, left], rows[at, left + 1])
            rows[at, left] = self.pair_ids[place]
            keep = np.ones((m, n), bool)
            keep[at, left + 1] = False
            rows = rows[keep].reshape(m, n - 1)
            keep = np.ones((m, n - 1), bool)
            keep[at, left] = False
            agenda = agenda[keep].reshape(m, n - 2)
            has = left > 0
            i, j = at[has], left[has]
            agenda[i, j - 1] = self._ranks(rows[i, j - 1], rows[i, j])
            has = left < n - 2
            i, j = at[has], left[has]
            agenda[i, j] = self._ranks(rows[i, j], rows[i, j + 1])
        return done

    def merge_long(self, part: str) -> list[str]:
        """The agenda is a heap.  An entry is one number, rank and left
        position; it is stale if the pair that now stands there has another
        rank."""
        symbols = list(part)
        n, rank = len(symbols), self.ranks.get
        agenda = []
        for i in range(n - 1):
            r = rank(part[i:i + 2])
            if r is not None:
                agenda.append(r << 32 | i)
        if not agenda:
            return symbols
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            entry = heappop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if not symbols[left] or right == n:
                continue  # merged into its left neighbour meanwhile
            pair = symbols[left] + symbols[right]
            if rank(pair) != entry >> 32:
                continue
            symbols[left], symbols[right] = pair, ""
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                r = rank(pair + symbols[nxt])
                if r is not None:
                    heappush(agenda, r << 32 | left)
            prev = before[left]
            if prev >= 0:
                r = rank(symbols[prev] + pair)
                if r is not None:
                    heappush(agenda, r << 32 | prev)
        return [s for s in symbols if s]

    def _as_ids(self, symbols: Iterable[int]) -> array:
        """Ids of symbols: a character that is no piece becomes byte pieces."""
        out = array("I")
        for symbol in symbols:
            if symbol < self.first_char:
                out.append(symbol)
            elif self.byte_fallback:
                out.extend(self.byte_ids[b] for b in
                           chr(symbol - self.first_char).encode("utf-8", "replace"))
            else:
                out.append(self.unk)
        return out

    def parts_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of non-empty parts as native unsigned 32-bit integers, all
        parts merged together."""
        if not parts:
            return []
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        part_ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        side = chars[:-1] << SYMBOL_BITS | chars[1:]
        cut = np.ones(len(chars), bool)
        cut[1:] = self.side_by_side.find(side) < 0
        cut[part_ends[:-1]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(chars))
        symbols = self.symbol_of[chars]
        long = np.flatnonzero(lengths > ROW_CHARS)
        done = self.merge_rows(symbols, starts, np.where(lengths > ROW_CHARS, 0, lengths))
        for run in long.tolist():
            text = "".join(map(chr, chars[starts[run]:starts[run] + lengths[run]].tolist()))
            merged = [self.ids[s] if s in self.ids else self.first_char + ord(s) for s in self.merge_long(text)]
            done.append((np.array([run]), np.array([merged], np.int64)))
        counts = np.zeros(len(starts), np.int64)
        for runs, rows in done:
            counts[runs] = rows.shape[1]
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]), np.int64)
        for runs, rows in done:
            flat[(ends[runs] - rows.shape[1])[:, None] + np.arange(rows.shape[1])] = rows
        # the last run of a part ends where the next part's first run starts
        bounds = ends[np.searchsorted(starts, part_ends) - 1]
        blob, stops = flat.astype(np.uint32).tobytes(), bounds.tolist()
        odd = np.zeros(len(parts), bool)
        odd[np.searchsorted(bounds, np.flatnonzero(flat >= self.first_char), side="right")] = True
        found, at = [], 0
        for stop, strange in zip(stops, odd.tolist()):
            found.append(self._as_ids(flat[at:stop].tolist()).tobytes() if strange else blob[4 * at:4 * stop])
            at = stop
        return found

    def cut(self, text: str) -> list[str]:
        """Parts of a normalized text, as ``parts`` finds them: replacements
        and one split take less than half of the expression's time."""
        if self.alone is None or "\0" in text:
            return self.parts.findall(text)
        text = text.replace(SPACE, "\0" + SPACE)
        if SPACE + "\0" + SPACE in text:
            # the first pass leaves pairs of marks, the second joins these
            for _ in range(2):
                text = text.replace(SPACE + "\0" + SPACE, SPACE + SPACE)
        for c in self.alone:
            if c in text:
                text = text.replace(c, f"\0{c}\0")
        return list(filter(None, text.split("\0")))

    def encode_chunk(self, texts: list[str]) -> list[array]:
        """Ids of texts with begin and end.  Parts are remembered; a full memo
        starts anew and takes over from its former content what is asked for
        again."""
        if len(self.known) >= self.memo:
            self.former, self.known = self.known, {}
        known, former = self.known, self.former
        texts_parts, found, new = [], [], set()
        for text in self.library.normalize(texts):
            parts = self.cut(text)
            ids = list(map(known.get, parts))
            if None in ids:
                new.update([p for p, i in zip(parts, ids) if i is None])
            else:
                parts = None  # all of them known
            texts_parts.append(parts)
            found.append(ids)
        if former:
            again = {p: former[p] for p in new if p in former}
            known.update(again)
            new -= again.keys()
        new = list(new)
        known.update(zip(new, self.parts_ids(new)))
        out = []
        for parts, ids in zip(texts_parts, found):
            whole = array("I", [self.bos])
            whole.frombytes(b"".join(ids if parts is None else map(known.__getitem__, parts)))
            whole.append(self.eos)
            out.append(whole)
        for part in new:
            if len(part) > MEMO_CHARS:
                del known[part]
        return out

    def encode(self, text: str) -> array:
        return self.encode_chunk([text])[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[str, array]]:
        """Texts with their ids, merged a chunk at a time."""
        chunk, chars = [], 0
        for text in texts:
            if chunk and chars + len(text) > CHUNK_CHARS:
                yield from zip(chunk, self.encode_chunk(chunk))
                chunk, chars = [], 0
            chunk.append(text)
            chars += len(text)
        if chunk:
            yield from zip(chunk, self.encode_chunk(chunk))

    def decode(self, ids) -> str:
        """Text of ids: byte pieces in a row are read as UTF-8, each invalid
        byte as U+FFFD; the space that encoding adds in front is dropped, unless
        it is a byte piece."""
        at = np.asarray(ids, dtype=np.int64)
        lengths = self.table_lengths[at]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return ""
        places = np.arange(ends[-1]) + np.repeat(self.table_starts[at] - ends + lengths, lengths)
        data = self.table_bytes[places].tobytes()
        first = next((i for i in ids if i not in self.hidden), None)
        if self.prefixed and data[:1] == b" " and first not in self.byte_values and first != self.unk:
            data = data[1:]
        return _utf8(data)


def _utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        # one mark for each byte that is not part of a valid sequence
        return re.sub("[\udc80-\udcff]", "�", data.decode("utf-8", "surrogateescape"))


@lru_cache(maxsize=1)
def codec(path: str, memo: int = MEMO) -> PieceCodec:
    return PieceCodec(path, memo)


def encode_texts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id",
                 text_col: str = "text", check: bool = True, memo: int = MEMO,
                 with_ids: bool = False) -> DataFrame:
    """One row per document: number of ids, digests of ids and of the decoded
    text, whether the library gives the same and, if asked for, the ids.

    Workers keep their memos after the task; ``memo`` bounds them, for jobs
    whose other stages need the memory."""
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
              ("agrees", pa.bool_())]

    def packed(owners: pa.Array, found: list[tuple], all_ids: list[np.ndarray]) -> pa.RecordBatch:
        columns = [owners, *(pa.array(c, t) for c, (_, t) in zip(zip(*found), fields))]
        names = ["_id", *(n for n, _ in fields)]
        if with_ids:
            ends = np.cumsum([0, *map(len, all_ids)], dtype=np.int64).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, memo)
        for batch in batches:
            owners, done, held = batch.column("_id"), 0, 0
            found, all_ids = [], []
            # texts become strings a chunk at a time, and results leave as often
            for text, ids in c.encode_all(t.as_py() for t in batch.column("_text")):
                decoded, agrees = c.decode(ids), None
                if with_ids:
                    all_ids.append(np.frombuffer(ids, np.uint32).astype(np.int32))
                le = ids if array("H", [1]).tobytes() == b"\x01\x00" else array("I", ids)
                if le is not ids:
                    le.byteswap()
                if check:
                    # 32-bit integers on both sides
                    theirs = c.library.encode_as_numpy(text, add_bos=True, add_eos=True)
                    agrees = theirs.tobytes() == ids.tobytes() and c.library.decode(theirs) == decoded
                found.append((len(ids), hashlib.sha256(le.tobytes()).hexdigest(),
                              hashlib.sha256(decoded.encode()).hexdigest(), agrees))
                held += len(text)
                if held >= CHUNK_CHARS:
                    yield packed(owners.slice(done, len(found)), found, all_ids)
                    done, held, found, all_ids = done + len(found), 0, [], []
            if found:
                yield packed(owners.slice(done, len(found)), found, all_ids)

    slim = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(
        rows, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
        + (", ids array<int>" if with_ids else "")
    ).withColumnRenamed("_id", id_col)
