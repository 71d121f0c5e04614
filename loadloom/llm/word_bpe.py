"""BPE encoding and decoding with an automaton that the merges are compiled into.

The automaton reads tokens and accepts just the sequences that the merges would leave. It begins as one state with
an arc for every base symbol. The merge of u and v then adds a gadget: the state that arcs of u
lead to is copied without its arc of v, arcs of u lead to the copy from now on, and each
state that had an arc of u gets one of uv, to the state behind v. A copy is held as the state that it
comes from and the arc that it lacks, and arcs of later tokens follow from those of their left
parts, so a merge costs one state. Moves that were asked for are kept in one table.

A word is encoded from its start to its end along arcs whose labels make it up, the longest first; just one way
ends with the word. A state is the token before and the place in the word. Its arcs are looked at once: a state from which no way leads to the
end is dead from then on. A word of n symbols has at most n times the longest token's length of states, each with as many arcs at most, so the steps grow
linearly with the word. Words seen before are looked up.

Defined results. A null text counts as empty; an empty text has no ids and decodes to an empty text. Texts are
taken whole. Symbols that the vocabulary lacks are left out, as the tokenizers library does for a
vocabulary without an unknown token. Strings of special tokens in a text give those tokens. Repeated rows
give equal results, and an empty table an empty one. Columns of the input that have the name of one of the operator's own are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import buffers, slices, without

#: Words and moves that a worker keeps; it starts anew beyond.
MOST_WORDS, MOST_MOVES = 500_000, 2_000_000
#: Longest word that is kept.
LONGEST = 48
#: The end mark inside this module: a character that byte characters don't include.
MARK = "\0"
#: Fixed value: the pattern by which vocabularies of this kind split texts.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Texts of these characters alone are lower-cased and split here; normalisation leaves them as they are.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_OTHER = re.compile("[^\x00-\x1b\x20-\x7e\u00a1\u00ab\u00bb\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


def _byte_chars() -> list[str]:
    """The characters that byte-level vocabularies write for the bytes."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


BYTE_CHARS = _byte_chars()


class Automaton:
    """Tokens are numbered as in the vocabulary.

    The states that arcs of token u have led to are u's family: a first state, which is that of u's right part when
    u was made, and one copy for each later merge of u with some v, which lacks the arc of v.
    A state is named by the token and the step up to which its copies count.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        most = max(vocab.values(), default=0) + 1
        self.left, self.right, self.born = [-1] * most, [-1] * most, [0] * most
        #: Of each family: the arcs that its copies lack, with the step of the copy, and the first such step.
        self.lacks: list[dict[int, int]] = [{} for _ in range(most)]
        self.first = [0] * most
        self.dead: set[int] = set()
        self.states = 1
        self.moves: dict[int, bool] = {}
        self.last = len(merges) + 1
        for step, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.born[w] or w in self.dead:
                continue  # this token was made before, and its parts never lie side by side again
            if not self._arc(u, step, v):
                self.dead.add(w)
                continue
            self.left[w], self.right[w], self.born[w] = u, v, step
            self.lacks[u][v] = step
            self.first[u] = self.first[u] or step
            self.states += 1

    def _arc(self, u: int, limit: int, token: int) -> bool:
        """Whether the state of u as of step ``limit`` has an arc of the token."""
        left, born = self.left, self.born
        if token in self.dead:
            return False
        while True:
            first = self.first[u]
            if first and first <= limit:
                lacks, upto = self.lacks[u], limit
                while True:
                    step = lacks.get(token)
                    if step is not None and step <= upto:
                        return False
                    made = born[token]
                    if made < first:
                        break
                    # The arc came with the merge of its left part, to the states that had an arc of that then.
                    upto = min(upto, made)
                    token = left[token]
            if not born[u]:
                return True
            # The copy for a merge is made after the merge's own token got its state.
            u, limit = self.right[u], born[u] - 1

    def follows(self, before: int, token: int) -> bool:
        """Whether the token may come after ``before``, by the table of moves."""
        key = before << 20 | token
        got = self.moves.get(key)
        if got is None:
            if len(self.moves) >= MOST_MOVES:
                self.moves.clear()
            got = self.moves[key] = self._arc(before, self.last, token)
        return got


class Coder:
    """One vocabulary file: its automaton, its way to split texts, and the chunks seen so far."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(self.vocab, merges)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.label = {i: s for s, i in (self.vocab | self.special).items()}
        #: Every beginning of a token, its end mark as one character -> the token that it is, or -1.
        self.begins: dict[str, int] = {}
        self.size: dict[int, int] = {}
        symbols = set()
        for token, i in self.vocab.items():
            text = token.removesuffix(self.end) + MARK if self.end and token.endswith(self.end) and token != self.end else token
            if not self.automaton.born[i]:
                if i in self.automaton.dead or len(text.removesuffix(MARK)) > 1:
                    continue
                symbols.add(text)
            self.size[i] = len(text)
            for k in range(1, len(text)):
                self.begins.setdefault(text[:k], -1)
            self.begins[text] = i
        self.symbols = symbols
        tools = Tokenizer.from_file(path)
        self.normalise = tools.normalizer.normalize_str if tools.normalizer else (lambda t: t)
        self.split = tools.pre_tokenizer.pre_tokenize_str
        pieces = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        rules = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.plain = rules == ["NFC", "Replace", "Lowercase"] and bool(pieces) and pieces[0].get("pattern", {}).get("Regex") == SPLIT
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: word -> its ids (little-endian unsigned 32-bit) and their labels
        self.known: dict[str, tuple[bytes, str]] = {}
        self.bytes_of = str.maketrans({c: "".join(BYTE_CHARS[b] for b in c.encode()) for c in map(chr, range(256))})

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids and labels of one pre-split word, written in byte characters."""
        text = word + MARK if self.end else word
        if any(c not in self.symbols for c in word[:-1]) or (word[-1] + MARK if self.end else word[-1]) not in self.symbols:
            # What isn't in the vocabulary goes; the end mark goes with the symbol that has it.
            symbols = [*word[:-1], word[-1] + MARK if self.end else word[-1]]
            text = "".join(c for c in symbols if c in self.symbols)
        ids = self.path(text)
        return np.array(ids, "<u4").tobytes(), self.decode(ids)

    def path(self, text: str) -> list[int]:
        """The one accepted sequence of tokens with this text; the longest token is tried first."""
        begins, moves, follows, n = self.begins.get, self.automaton.moves.get, self.automaton.follows, len(text)
        out: list[int] = []
        tries: list[list[tuple[int, int]]] = []
        dead: set[tuple[int, int]] = set()
        at, before = 0, -1
        while at < n:
            found = []
            i = at + 1
            token = begins(text[at:i])
            while token is not None:
                if token >= 0:
                    found.append((token, i))
                i += 1
                if i > n:
                    break
                token = begins(text[at:i])
            while True:
                while found:
                    token, i = found.pop()
                    if dead and (token, i) in dead:
                        continue
                    if before < 0:
                        break
                    ok = moves(before << 20 | token)
                    if ok or ok is None and follows(before, token):
                        break
                else:
                    if not out:
                        raise ValueError(f"no tokens make {text!r}")
                    # No arc of this state leads to the end: back to the place where its token began.
                    dead.add((out.pop(), at))
                    at, before = at - self.size[before], out[-1] if out else -1
                    found = tries.pop()
                    continue
                break
            tries.append(found)
            out.append(token)
            at, before = i, token
        return out

    def decode(self, ids) -> str:
        """The arc labels of the ids, as the library joins them for a vocabulary without a decoder."""
        return " ".join([self.label[i] for i in ids])

    def learn(self, key: str, word: str) -> tuple[bytes, str]:
        got = self.word(word)
        if len(key) <= LONGEST:
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            self.known[key] = got
        return got

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        if self.at_special and self.at_special.search(text):
            out = []
            for piece in self.at_special.split(text):
                if piece in self.special:
                    out.append((np.array([self.special[piece]], "<u4").tobytes(), piece))
                elif piece:
                    out += self.parts(piece)
            return out
        known, learn = self.known.get, self.learn
        if self.plain and not _OTHER.search(text):
            return [known(w) or learn(w, w.translate(self.bytes_of)) for w in _PLAIN.findall(text.lower())]
        # Keys of this kind begin with a blank, which no word of the other kind does.
        return [known(" " + w) or learn(" " + w, w) for w, _ in self.split(self.normalise(text))]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text."""
        got = self.parts(text)
        return b"".join([a for a, _ in got]), " ".join([b for _, b in got if b])


@functools.cache
def coder(path: str) -> Coder:
    """One coder a worker and file."""
    return Coder(path)


def encode_decode(df: DataFrame, tokenizer_path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids``, ``decoded``) in the place of the text."""
    own = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        own += [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    base = without(df, *[n for n, _ in own if n != text_col.lower()])
    where = base.columns.index(text_col)
    rest = [f for f in base.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, *(T.StructField(n, t) for n, t in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            _, at = buffers(batch.column(where))
            for i, j in slices(at):
                rows = batch.slice(i, j - i)
                got = [code.encode(t or "") for t in rows.column(where).to_pylist()]
                cols = [pa.array([len(a) // 4 for a, _ in got], pa.int64()), pa.array([sha(a) for a, _ in got]), pa.array([sha(b.encode()) for _, b in got])]
                if with_ids:
                    cols += [pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([b for _, b in got])]
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(rows.columns) if k != where), *cols], [f.name for f in schema.fields])

    return base.mapInArrow(run, schema)
