"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

From the merge list alone a sufficient lookahead is computed: a token that
ends so many bytes before the end of what was read is the same whatever is
read next (:func:`sufficient_lookahead`). A text is read piece by piece;
pre-tokens are passed on once no later character can move their ends, and of a
pre-token that stays open (a run of a million letters) tokens are passed on as
soon as they are stable. What is kept between pieces is bounded by the piece,
the lookahead and the longest token, not by the text. Decoding looks up the
bytes of ids, block by block, and turns them into text with a state machine
that holds back the bytes of an unfinished character.

The right context never decides more than the lookahead. Let two strings agree
up to position d, the second going on. Rules are applied by rank, each from
left to right, so the first position where the two segmentations differ moves
left only when a rule (u, v) merges over it in one of them, and then by the
length of u. The next rule that moves it has a later rank and a v that begins
at the new position with the token u. So the sum of the u along the longest
such chain of rules bounds how far a difference can reach.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, worker_table
from .packing import default_tokenizer_path

#: Characters read at a time, and the most ids decoded at a time.
PIECE = 1 << 16
#: Words longer than this are merged with a heap, one by one.
LONG_WORD = 64
#: Pre-tokens whose ids a worker remembers before it starts afresh (about 60 MB).
WORD_LIMIT = 200_000
#: Characters of texts that step together, so that new words are merged together.
TOGETHER = 1 << 19
_NONE = np.int64(1 << 40)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that fix it, for a merge list in order of rank."""
    left = {a + b: a for a, b in merges}
    reach: dict[bytes, int] = {}
    most = 0
    for a, b in merges:
        longest, begins = 0, b
        while begins is not None:
            longest = max(longest, reach.get(begins, 0))
            begins = left.get(begins)
        here = len(a) + longest
        reach[a] = max(reach.get(a, 0), here)
        most = max(most, here)
    return most


def character_classes(tokenizer) -> dict[tuple[str, bool], str]:
    """Regular expression classes of the letters, numbers and white space of the tokenizer's own Unicode version.

    Those up to U+FFFF and those beyond apart. Code points that are newer than Python's tables are asked of the tokenizer itself.
    """
    import regex

    newer = regex.compile(r"[\p{L}\p{N}]")
    whole = lambda text: len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1
    found: dict[str, list[int]] = {"L": [], "N": [], "S": []}
    for c in range(0x110000):
        char = chr(c)
        kind = unicodedata.category(char)
        if kind[0] in "LN":
            found[kind[0]].append(c)
        elif kind == "Cn" and newer.match(char):
            for k, before in (("L", "a"), ("N", "1")):
                if whole(before + char):
                    found[k].append(c)
        elif char.isspace() and not 0x1C <= c <= 0x1F:
            found["S"].append(c)
    out = {}
    for kind, codes in found.items():
        for low in (True, False):
            own = np.array([c for c in codes if (c < 0x10000) == low], np.int64)
            cuts = np.split(own, np.flatnonzero(np.diff(own) != 1) + 1) if len(own) else []
            out[kind, low] = "".join(f"\\U{x[0]:08x}-\\U{x[-1]:08x}" for x in cuts)
    return out


def _pretokens(letters: str, numbers: str, blank: str) -> re.Pattern:
    """Fixed by byte-level BPE: contractions, then runs with a space before them, then white space."""
    other = f"[^{letters}{numbers}{blank}]"
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?{other}+|[{blank}]+(?![^{blank}])|[{blank}]+"
    )


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


class Merges:
    """A byte-level BPE vocabulary with its merge list, from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, before = made["model"], made["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or made["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without prefix spaces and normalisers is read")
        if any(t[k] for t in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that look at their neighbours are not read")
        shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        plain = lambda token: bytes(byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        vocabulary = {plain(t): i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(plain(a), plain(b)) for a, b in pairs]
        known = {t for t in vocabulary if len(t) == 1}
        for a, b in merges:
            if a not in known or b not in known or a + b in known:
                raise ValueError(f"{path}: the merge list makes {a + b!r} twice or from later tokens")
            known.add(a + b)
        self.lookahead = sufficient_lookahead(merges)
        self.size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.bytes_of = [b""] * self.size
        for token, i in vocabulary.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        #: Bytes of an open pre-token that are merged at once: some of its tokens are stable then.
        self.window = 2 * self.lookahead + max(map(len, self.bytes_of))
        self.of_byte = np.array([vocabulary[bytes([b])] for b in range(256)])
        self.rank = {(vocabulary[a], vocabulary[b]): r for r, (a, b) in enumerate(merges)}
        self.made = np.array([vocabulary[a + b] for a, b in merges])
        keys = np.array([a * self.size + b for a, b in self.rank], np.int64)
        self.order = np.argsort(keys).astype(np.int64)
        self.of_bytes = np.full((256, 256), _NONE)
        for r, (a, b) in enumerate(merges):
            if len(a) == len(b) == 1:
                self.of_bytes[a[0], b[0]] = r
        self.keys = np.append(keys[self.order], np.int64(1) << np.int64(62))
        self.order = np.append(self.order, 0)
        classes = character_classes(Tokenizer.from_file(path))
        every = lambda kind: "".join(classes[kind, low] for low in (True, False))
        # Texts without characters beyond U+FFFF, nearly all, are matched faster without those.
        self.low = _pretokens(*(classes[kind, True] for kind in "LNS"))
        self.every = _pretokens(*map(every, "LNS"))
        letters, numbers, blank = map(every, "LNS")
        self.runs = [re.compile(f"[{c}]*") for c in (letters, numbers, f"^{letters}{numbers}{blank}", blank)]
        specials = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.starts = tuple({s[:n] for s in specials for n in range(1, len(s))})
        self.known: dict[str, bytes] = {}

    def pretokens(self, text: str) -> list[str]:
        low = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        return (self.low if low else self.every).findall(text)

    def merge_long(self, data: bytes) -> list[int]:
        """Ids of one word: merges by rank, then from left to right, with a heap."""
        ids = self.of_byte[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], k = int(self.made[r]), -1, after[j]
            after[i] = k
            if k < n:
                prior[k] = i
                if (s := self.rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            if (h := prior[i]) >= 0 and (s := self.rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def _ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        pairs = first * self.size + second
        at = np.searchsorted(self.keys, pairs)
        return np.where(self.keys[at] == pairs, self.order[at], _NONE)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of many short words: in each round, every word makes all merges of its least rank."""
        data = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids = self.of_byte[data]
        # The rank of each symbol with its follower; none at the last of a word.
        ranks = np.append(self.of_bytes[data[:-1], data[1:]], _NONE)
        ranks[np.append(owner[1:] != owner[:-1], True)] = _NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(ranks, starts)
            least = np.repeat(least, np.diff(np.append(starts, len(ids))))
            going = least < _NONE
            if not going.all():
                done.append((owner[~going], ids[~going]))
                ids, owner, ranks, least = ids[going], owner[going], ranks[going], least[going]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == least)
            # Of pairs that overlap (a rule of twice one token), every second from the left.
            first = np.append(True, np.diff(at) != 1)
            inside = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            at = at[inside % 2 == 0]
            ids[at] = self.made[ranks[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ranks[at] = _NONE
            ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
            at -= np.arange(len(at))
            # Only pairs with a new symbol have new ranks.
            for k in (at[at + 1 < len(ids)], at[at > 0] - 1):
                k = k[owner[k] == owner[k + 1]]
                ranks[k] = self._ranks(ids[k], ids[k + 1])
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        flat = np.concatenate([i for _, i in done])[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owners, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, words: set[str]) -> None:
        """Merge and remember the ids of complete pre-tokens."""
        if len(self.known) >= WORD_LIMIT:
            self.known.clear()
        raw = {w: w.encode() for w in words}
        short = [w for w, b in raw.items() if len(b) <= LONG_WORD]
        if short:
            self.known.update(zip(short, self.merge_words([raw[w] for w in short]), strict=True))
        for w in words.difference(short):
            self.known[w] = packed(self.merge_long(raw[w]))


class Encoder:
    """The transducer over one text: pieces in, complete pre-tokens and stable ids out.

    ``feed`` gives segments in order: lists of pre-tokens (str), whose ids are
    to be looked up, and packed ids. It keeps the characters whose
    pre-token can still change, and of an open long pre-token the bytes that
    are not stable.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.marked = ""  # what may begin a special token
        self.held = ""  # characters of pre-tokens that can change
        self.open = b""  # unstable bytes of a long pre-token
        self.run = None  # what goes on with it

    def feed(self, piece: str, final: bool) -> list[list[str] | bytes]:
        m, out = self.merges, []
        text, self.marked = self.marked + piece, ""
        if m.specials:
            low = 0
            for found in m.specials.finditer(text):
                out += self._plain(text[low : found.start()], True)
                out.append(packed([m.special[found[0]]]))
                low = found.end()
            text = text[low:]
            if not final:
                ends = [s for s in m.starts if text.endswith(s)]
                if ends:
                    cut = len(text) - max(map(len, ends))
                    text, self.marked = text[:cut], text[cut:]
        return out + self._plain(text, final)

    def _plain(self, text: str, final: bool) -> list[list[str] | bytes]:
        """Text without special tokens; ``final`` at the end of the text or before a special token."""
        out: list[list[str] | bytes] = []
        text, self.held = self.held + text, ""
        if self.run is not None:
            more = self.run.match(text).end()
            if self.run is self.merges.runs[3]:
                # Of white space that goes on, the last character stays apart unless the text ends.
                stop = more if final and more == len(text) else max(more - 1, 0)
            else:
                stop = more
            goes_on = more == len(text) and not final
            out += self._stable(text[:stop], not goes_on)
            text = text[stop:]
            if goes_on:
                self.held = text
                return out
            self.run = None
        words = self.merges.pretokens(text)
        if final or not words:
            return out + ([words] if words else [])
        # Only the last pre-token can change, or an apostrophe before it.
        keep = 2 if words[-2:-1] == ["'"] else 1
        self.held = "".join(words[-keep:])
        words = words[:-keep]
        if words:
            out.append(words)
        if keep == 1 and len(self.held) > self.merges.window:
            begins, self.held = self.held, ""
            self.run = next(r for r in self.merges.runs if r.match(begins, len(begins) - 1).end() == len(begins))
            if self.run is self.merges.runs[3]:
                begins, self.held = begins[:-1], begins[-1]
            out += self._stable(begins, False)
        return out

    def _stable(self, text: str, closed: bool) -> list[bytes]:
        """Ids of the open pre-token that no longer change; all of them once it is closed."""
        m, out = self.merges, []
        data = text.encode()
        for low in range(0, max(len(data), 1), m.window):
            self.open += data[low : low + m.window]
            end = closed and low + m.window >= len(data)
            ids = m.merge_long(self.open) if self.open else []
            if not end:
                ends = np.cumsum([len(m.bytes_of[i]) for i in ids]) if ids else np.zeros(0, np.int64)
                count = int(np.searchsorted(ends, len(self.open) - m.lookahead, "right"))
                self.open = self.open[int(ends[count - 1]) if count else 0 :]
                ids = ids[:count]
            else:
                self.open = b""
            if ids:
                out.append(packed(ids))
        return out


def encode_texts(merges: Merges, texts: list[str]) -> list[np.ndarray]:
    """Ids of whole texts. The transducers take a piece each in turn; new pre-tokens of a turn are merged together."""
    states = [Encoder(merges) for _ in texts]
    found: list[list[bytes]] = [[] for _ in texts]
    going, low = list(range(len(texts))), 0
    while going:
        turn = [(k, states[k].feed(texts[k][low : low + PIECE], low + PIECE >= len(texts[k]))) for k in going]
        words = set().union(*(s for _, segments in turn for s in segments if type(s) is list))
        if len(merges.known) >= WORD_LIMIT:
            merges.known.clear()
        new = words.difference(merges.known)
        if new:
            merges.learn(new)
        known = merges.known.__getitem__
        for k, segments in turn:
            for s in segments:
                found[k].append(b"".join(map(known, s)) if type(s) is list else s)
        low += PIECE
        going = [k for k in going if low < len(texts[k])]
    return [np.frombuffer(b"".join(f), "<i4") for f in found]


class Decoder:
    """Text of ids as they come: bytes that do not yet end a character are kept for the next ids.

    Bytes that no character can hold become U+FFFD, one for each longest part that begins a character.
    """

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], final: bool) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), final)


def decode_ids(merges: Merges, ids: np.ndarray) -> str:
    state = Decoder(merges.bytes_of)
    blocks = range(0, max(len(ids), 1), PIECE)
    return "".join(state.feed(ids[low : low + PIECE].tolist(), low + PIECE >= len(ids)) for low in blocks)


def loaded(path: str) -> Merges:
    made = worker_table("bpe_stream", dict)
    if path not in made:
        made[path] = Merges(path)
    return made[path]


def _turns(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that step together."""
    low, total = 0, 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= TOGETHER or k + 1 - low >= 512:
            yield low, k + 1
            low, total = k + 1, 0
    if low < len(texts):
        yield low, len(texts)


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text, as the tokenizer of that file gives them.

    No special ids are added; special tokens that a text names have their one
    id. A null text is empty; an empty text has no ids. Rows are encoded on
    their own: repeated rows and null ids come out as they went in, and an
    empty table gives no rows.
    """
    path = tokenizer_path or default_tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe_stream")
        merges = loaded(path)
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for low, high in _turns(texts):
                    ids = encode_texts(merges, texts[low:high])
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
                    yield pa.record_batch([part.column(0).slice(low, high - low), lists], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids and text of rows of ids; null ids are empty, ids outside the vocabulary stand for nothing."""
    path = tokenizer_path or default_tokenizer_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe_stream")
        merges = loaded(path)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = []
                for ids in part.column(1):
                    flat = np.zeros(0, np.int64) if ids.values is None else ids.values.drop_null().to_numpy()
                    texts.append(decode_ids(merges, flat[(flat >= 0) & (flat < merges.size)]))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids array<int>, text string")


def transcode_digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, and decoded again from its ids."""
    back = decode_documents(encode_documents(docs, tokenizer_path), tokenizer_path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
