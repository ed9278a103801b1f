"""BPE encoding and decoding by a tokenization automaton.

compile_merges() turns a merge list into a deterministic automaton over tokens: it starts from the automaton with one
state for each base symbol and an arc for every pair, and applies one merge gadget after the other. The gadget of
(a, b) -> c takes the arc b out of the state that a leads to, gives every state that has an arc a (and then b) an arc c
to a new state, and lets that state go on as the state after b did. What is left at the end accepts exactly the
tokenizations that the merges yield. A word is encoded by one pass over its bytes and its end: a transition table over
bytes gives the longest token that ends at each place, links give the shorter ones, and of these the one whose arc leaves
the state reached before it is the one; the path through those arcs is the encoding. Decoding emits the arcs' labels.

Cases: a null or empty text has no ids and decodes to the empty text. Special tokens that stand in a text become their
ids, as the tokenizers library does. Very long words take time in proportion to their length. Repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillspark.llm.common import tidy

#: How many encoded words a worker keeps at most. This bounds memory only; a word that was let go is encoded again.
WORDS_KEPT = 120_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest moves above U+0100."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in stays else chr(next(moved)) for b in range(256)]


#: The symbol after a word's bytes.
END = 256


class Spelling:
    """Transitions over bytes and END that follow the longest beginning of a token which ends at each place.

    table: the next state by row and symbol. row: of each state; a state that nothing goes on from shares the row of the one it fails to. token: the longest token that ends in a state (-1: none), size: its symbols,
    shorter: the state of the next shorter one (0: none).
    """

    def __init__(self, inner: dict[bytes, int], final: dict[bytes, int]):
        child: list[dict[int, int]] = [{}]
        own, depth = [-1], [0]
        for spelled, ids, ends in ((x, y, end) for tokens, end in ((inner, ()), (final, (END,))) for x, y in tokens.items()):
            at = 0
            for symbol in (*spelled, *ends):
                if symbol not in child[at]:
                    child[at][symbol] = len(child)
                    child.append({})
                    own.append(-1)
                    depth.append(depth[at] + 1)
                at = child[at][symbol]
            own[at] = ids
        n = len(child)
        table = np.zeros((sum(map(bool, child)), END + 1), dtype=np.int32)
        self.row, rows = [0] * n, 0
        fail, self.token, self.size, self.shorter = [0] * n, [-1] * n, [0] * n, [0] * n
        queue = [0]
        for at in queue:  # breadth first, so what a state fails to is complete
            if child[at]:
                self.row[at], rows = rows, rows + 1
                if at:
                    table[self.row[at]] = table[self.row[fail[at]]]
            else:
                self.row[at] = self.row[fail[at]]
            back = fail[at]  # the longest token that ends here: the state's own string, or that of the state it fails to
            self.token[at], self.size[at], self.shorter[at] = (own[at], depth[at], back) if own[at] >= 0 else (self.token[back], self.size[back], self.shorter[back])
            for symbol, to in child[at].items():
                fail[to] = int(table[self.row[at], symbol]) if at else 0
                table[self.row[at], symbol] = to
                queue.append(to)
        self.table = memoryview(table.reshape(-1))


class Automaton:
    """The compiled tables: states' arcs as bit rows, transitions over bytes, and the arc labels for decoding."""

    def __init__(self, rows: list[bytes], state: dict[int, int], inner: dict[bytes, int], final: dict[bytes, int], labels: dict[int, str], special: dict[str, int]):
        self.rows, self.state, self.special = rows, state, special
        self.after = {t: rows[s] for t, s in state.items()}
        self.spelling = Spelling(inner, final)
        self.labels = np.array([labels.get(i, "") for i in range(max(labels) + 1)], dtype=object)

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        s, after = self.spelling, self.after
        table, row, tokens, sizes, shorter = s.table, s.row, s.token, s.size, s.shorter
        ends: list[tuple[int, int]] = [(0, -1)]  # for each prefix: where its last token starts, and that token
        state = 0
        for i, symbol in enumerate((*word, END), 1):
            state = table[row[state] * (END + 1) + symbol]
            of, found = state, (0, -1)
            while (token := tokens[of]) >= 0:
                at = i - sizes[of]
                before = ends[at][1]
                if at == 0 or (before >= 0 and before in after and after[before][token >> 3] >> (token & 7) & 1):
                    found = (at, token)
                    break
                of = shorter[of]
            ends.append(found)
        ids, at = [], len(word) + 1
        while at:
            at, token = ends[at]
            if token < 0:
                raise ValueError(f"the vocabulary has no symbol for {word!r}")
            ids.append(token)
        return ids[::-1]

    def decode(self, ids: np.ndarray) -> str:
        """The arcs' labels, a blank between them."""
        return " ".join(self.labels[ids].tolist())


def compile_merges(symbols: list[tuple[bytes, bool]], merges: list[tuple[int, int]], ids: list[int], labels: dict[int, str], special: dict[str, int]) -> Automaton:
    """symbols: bytes of each base symbol and whether it ends a word. merges: pairs of token numbers in order; the k-th makes token len(symbols) + k. ids: the vocabulary's id of each token number."""
    spelled, ends = [s for s, _ in symbols], [e for _, e in symbols]
    for a, b in merges:
        spelled.append(spelled[a] + spelled[b])
        ends.append(ends[b])
    n, base = len(spelled), len(symbols)
    state = np.full(n, -1)  # only tokens inside a word have arcs after them
    state[[t for t in range(n) if not ends[t]]] = np.arange(n - sum(ends))
    count = int(state.max()) + 1
    arcs = np.zeros(((max(ids) >> 6) + 1, count), dtype=np.uint64)  # bit id of column block id >> 6: the state has an arc with that label
    one = np.uint64(1)
    begun = [int(state[t]) for t in range(base) if state[t] >= 0]
    for t in range(base):
        arcs[ids[t] >> 6, begun] |= one << np.uint64(ids[t] & 63)
    for k, (a, b) in enumerate(merges):
        c, after_a = base + k, state[a]
        ia, ib, ic = ids[a], ids[b], ids[c]
        has_a = (arcs[ia >> 6] >> np.uint64(ia & 63)) & one
        arcs[ic >> 6] |= has_a << np.uint64(ic & 63)  # the arc c beside every arc a
        if state[c] >= 0:
            arcs[:, state[c]] = arcs[:, state[b]]  # and on from there as after b
        arcs[ib >> 6, after_a] &= ~(one << np.uint64(ib & 63))  # a followed by b is no tokenization any more
        if a == b:  # of three in a row the first two merge
            arcs[ic >> 6, after_a] &= ~(one << np.uint64(ic & 63))
    rows, seen, of = [], {}, {}
    for t in range(n):  # equal states are one
        if state[t] >= 0:
            row = arcs[:, state[t]].astype("<u8").tobytes()
            of[ids[t]] = seen.setdefault(row, len(seen))
            if len(seen) > len(rows):
                rows.append(row)
    return Automaton(rows, of, {spelled[t]: ids[t] for t in range(n) if not ends[t]}, {spelled[t]: ids[t] for t in range(n) if ends[t]}, labels, special)


def from_file(path: str) -> Automaton:
    """The automaton of a byte-level BPE vocabulary with word ends, in the tokenizers library's JSON format."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    vocab = model["vocab"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    symbols, ids, number = [], [], {}
    for byte, char in enumerate(byte_symbols()):
        for text, ends in ((char, False), (char + end, True)):
            if text in vocab:
                number[text] = len(symbols)
                symbols.append((bytes([byte]), ends))
                ids.append(vocab[text])
    merges = []
    for pair in model["merges"]:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((number[left], number[right]))
        number[left + right] = len(ids)
        ids.append(vocab[left + right])
    if len(set(ids)) < len(ids):
        raise ValueError("two merges make the same token; the automaton needs one merge for each")
    labels = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
    return compile_merges(symbols, merges, ids, labels, special)


#: Fixed pattern of the vocabulary's pre-tokenizer: contractions, runs of letters, single digits, runs of other signs.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: Where this Python's tables of letters and cases and the library's are the same; a text with other characters is split by the library itself.
USUAL = regex.compile(r"[\0-\u0377\u0391-\u03a1\u03a3-\u03ff\u0400-\u0482\u048a-\u052f\u2010-\u206e\u20a0-\u20bf\u3041-\u3096\u30a0-\u30ff\u4e00-\u9ffc\uac00-\ud7a3\U0001f300-\U0001f6d7]*")


class Words(dict):
    """Encoded words; those used lately survive when it is full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.before = automaton, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = np.array(self.automaton.encode_word(word.encode()), dtype="<u4").tobytes()
        if len(self) >= WORDS_KEPT // 2:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Whole texts to ids and back."""

    def __init__(self, automaton: Automaton, path: str):
        self.words, self.automaton, self.path, self.library = Words(automaton), automaton, path, None
        self.special = regex.compile("|".join(map(regex.escape, sorted(automaton.special, key=len, reverse=True)))) if automaton.special else None
        self.marks = {x[:2] for x in automaton.special}

    def split(self, text: str) -> list[str]:
        """Normalised, pre-split words."""
        if text.isascii():
            return WORD.findall(text.lower())
        if USUAL.fullmatch(text):
            return WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())  # lower() knows a final sigma, the vocabulary's normalizer doesn't
        if self.library is None:
            import tokenizers

            self.library = tokenizers.Tokenizer.from_file(self.path)
            self.bytes_of = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
        whole, back = self.library.normalizer.normalize_str(text), self.bytes_of
        return [b"".join(back[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]

    def plain(self, text: str) -> bytes:
        """Ids of text without special tokens, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        if self.special is None or not any(x in text for x in self.marks):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.automaton.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary, compiled when first asked for."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(from_file(path), path)
    return _ENCODERS[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: the id, n_tokens, the digests of ids and decoded text, and with keep_ids the ids and decoded text themselves.

    vocabulary is a path to the JSON file that every executor can open; each worker process compiles it once.
    """
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                ids = [code.encode(t.as_py() or "") for t in part.column(1)]
                decoded = [code.automaton.decode(np.frombuffer(x, "<u4")) for x in ids]
                out = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
                if keep_ids:
                    out += [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
