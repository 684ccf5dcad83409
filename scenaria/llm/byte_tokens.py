"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens. It has a start state and, for each token x, the state after x; an arc y leaves that state
if y may follow x in the encoding of some word. It begins with single bytes, any of which may follow any other, and the
merges are built in one after the other. The gadget of the merge u v -> w, applied to every path q -u-> p -v-> r, is

* the state after u loses its arc v,
* each state with an arc u gets an arc w (the state after u itself does not, if u = v: pairs are merged from the left),
* the state after w is a copy of the state after v as it then was: later gadgets change only one of the two.

After the last merge each word has exactly one path from the start state that spells it, and that path is its encoding.
Written out, the table has an entry for each pair of tokens. It is kept as its gadgets: the arc lost, with the gadget's
number, and for each token the states copied (``right``) and the arc followed (``left``). Whether x has the arc y is
found by going back from the younger of the two to what it was copied from, and is then a plain table entry.

A word is encoded by reading it from its start along the longest token that the present state has an arc for. Where no
arc leads on, the place is marked as dead and the token before gives way to its next shorter prefix; as a place has one
state only, no place is entered twice after that. Decoding emits the arcs' labels.

Texts are split into words by the vocabulary's pattern; special tokens in a text are cut out first, unless told not to.
Letters and numbers are those of Unicode 16, as in the library whose vocabulary files these are.

A null text counts as empty, an empty text has no tokens. Null ids, repeated rows and further columns are carried through;
an empty table gives an empty result. Texts are taken whole; a task remembers words up to REMEMBERED of them (a matter of
cost only). The automaton is made on the driver and sent with the job; its size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Words remembered in a task; at more, all are forgotten. Longer words than LONGEST are not remembered.
REMEMBERED = 600_000
LONGEST = 64
#: Letters and numbers that came with Unicode 17 (first and last code points), here marks like other unknown characters.
NEW = ((0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
       (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
       (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
       (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
       (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
       (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
       (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
       (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
       (0x323B0, 0x33479), (0x3D000, 0x3FC3F))
#: Words that are looked up together, so that a very long text is never held as a list of words.
BLOCK = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if it is visible, else one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_pattern():
    """(The pattern that splits a text into words, one that finds NEW, one that splits a text with such characters)."""
    import regex

    late = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEW)
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\s+(?!\S)|\s+"
    plain = words.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{O}", r"[^\s\p{L}\p{N}]")
    exact = words.replace("{L}", rf"[\p{{L}}--[{late}]]").replace("{N}", rf"[\p{{N}}--[{late}]]").replace("{O}", rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]")
    return regex.compile(plain), regex.compile(f"[{late}]"), regex.compile(f"(?V1){exact}")


def latin(text: str) -> bool:
    """Whether all characters are below U+0100; no letter or number there is new."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Automaton:
    """The automaton of a byte-level BPE vocabulary in a tokenizers file."""

    def __init__(self, model_file: str = MODEL):
        with open(model_file, encoding="utf-8") as f:
            whole = json.load(f)
        model, splitter = whole["model"], whole["pre_tokenizer"] or {}
        if (model["type"], splitter.get("type")) != ("BPE", "ByteLevel") or whole["normalizer"] or splitter["add_prefix_space"] or not splitter["use_regex"]:
            raise ValueError(f"{model_file} is no plain byte-level BPE vocabulary")
        letters = byte_letters()
        special = [t for t in whole["added_tokens"] if t["special"]]
        if len(special) < len(whole["added_tokens"]) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError(f"{model_file} has added tokens of other kinds")
        self.special = {t["content"]: t["id"] for t in special}
        self.labels = [b""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for name, i in model["vocab"].items():
            self.labels[i] = bytes(letters[c] for c in name)
        for name, i in self.special.items():
            self.labels[i] = name.encode()
        n = len(self.labels)
        self.born, self.left, self.right = [0] * n, [-1] * n, [-1] * n
        self.lost: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        self.ids = {self.labels[i]: i for name, i in model["vocab"].items() if len(name) == 1}
        if len(self.ids) < 256:
            raise ValueError(f"{model_file} lacks bytes")
        for number, pair in enumerate(model["merges"], 1):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self.build_in(number, model["vocab"][u], model["vocab"][v], model["vocab"][u + v])
        self._prefixes()

    def build_in(self, number: int, u: int, v: int, w: int) -> None:
        """The gadget of the merge u v -> w; nothing, if no state after u has an arc v any more."""
        if self.labels[w] in self.ids:
            raise ValueError("two merges make one token")
        if self.has_arc(u, v, number):
            self.lost[u << 32 | v] = number
            self.born[w], self.left[w], self.right[w] = number, u, v
            self.ids[self.labels[w]] = w

    def has_arc(self, x: int, y: int, before: int = 1 << 62) -> bool:
        """Whether the state after x has an arc y, with the gadgets numbered below ``before`` built in."""
        lost, born = self.lost, self.born
        while lost.get(x << 32 | y, before) >= before:
            if born[x] > born[y]:
                before, x = born[x], self.right[x]  # a copy of the state after its right part, made then
            elif born[y]:
                before, y = born[y] + 1, self.left[y]  # the gadget that took the arc left before y itself counts, too
            else:
                return True
        return False

    def _prefixes(self) -> None:
        self.size = [len(x) for x in self.labels]
        self.shorter = [-1] * len(self.labels)
        self.reach: dict[bytes, int] = {}
        for label, i in self.ids.items():
            self.shorter[i] = next((self.ids[label[:k]] for k in range(len(label) - 1, 0, -1) if label[:k] in self.ids), -1)
            self.reach[label[:2]] = max(self.reach.get(label[:2], 0), len(label))

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of the one path that spells ``word``."""
        ids, size, shorter, reach, arcs = self.ids, self.size, self.shorter, self.reach, self.arcs
        if word in ids:
            return [ids[word]]
        path: list[int] = []
        dead = bytearray(len(word) + 1)
        at, n, x, y, fresh = 0, len(word), -1, -1, True
        while at < n:
            if fresh:
                for k in range(min(n - at, reach.get(word[at: at + 2], 1)), 0, -1):
                    y = ids.get(word[at: at + k], -1)
                    if y >= 0:
                        break
            while y >= 0:
                if not dead[at + size[y]]:
                    if x < 0:
                        break
                    key = x << 32 | y
                    ok = arcs.get(key)
                    if ok is None:
                        ok = arcs[key] = self.has_arc(x, y)
                    if ok:
                        break
                y = shorter[y]
            fresh = y >= 0
            if fresh:
                path.append(y)
                at += size[y]
                x = y
            else:
                dead[at] = 1
                last = path.pop()
                at -= size[last]
                x, y = path[-1] if path else -1, shorter[last]
        return path


class Encoder(dict):
    """Encodes and decodes texts; as a dictionary, the ids (as little-endian 32-bit integers) of words met before."""

    def __init__(self, automaton: Automaton, specials: bool = True):
        import regex

        self.automaton = automaton
        self.pattern, self.late, self.exact = word_pattern()
        self.names = sorted(automaton.special, key=len, reverse=True) if specials else []
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.names)) + ")")
        self.flat = np.frombuffer(b"".join(automaton.labels), np.uint8)
        self.size = np.array(automaton.size, np.int64)
        self.start = np.cumsum(self.size) - self.size

    def cut(self, word: str) -> list[int]:
        return self.automaton.encode_word(word.encode())

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.cut(word), "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out

    def splitter(self, text: str):
        """The pattern for this text: the plain one unless the text has letters that only the pattern library knows."""
        return self.exact if not latin(text) and self.late.search(text) else self.pattern

    def _words(self, text: str) -> bytes:
        pattern = self.splitter(text)
        if len(text) <= BLOCK:
            return b"".join(map(self.__getitem__, pattern.findall(text)))
        words, out = (m.group() for m in pattern.finditer(text)), []
        while block := list(islice(words, BLOCK)):
            out.append(b"".join(map(self.__getitem__, block)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not any(name in text for name in self.names):
            return self._words(text)
        parts, known = self.special.split(text), self.automaton.special
        return b"".join(np.array([known[p]], "<u4").tobytes() if i % 2 else self._words(p) for i, p in enumerate(parts))

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The labels of the arcs ``ids``, one after the other, as bytes."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids spell; bytes that are no UTF-8 become U+FFFD."""
        return self.spell(ids).tobytes().decode("utf-8", "replace")


def _batches(automaton: Automaton, specials: bool, names: list[str], check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(automaton, specials)
        for batch in batches:
            at, texts = 0, batch.column("text")
            while at < len(texts):
                done, total = [], 0
                for k in range(at, len(texts)):
                    done.append(encoder.encode(texts[k].as_py() or ""))
                    total += len(done[-1])
                    if total > 1 << 22:
                        break
                columns = {n: batch.column(n).slice(at, len(done)) for n in names}
                at += len(done)
                count = np.array([len(x) // 4 for x in done], np.int64)
                if check:
                    columns["n_tokens"] = pa.array(count)
                    columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in done], pa.string())
                    columns["decoded_sha256"] = pa.array(
                        [hashlib.sha256(encoder.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in done], pa.string())
                else:
                    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    columns["tokens"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(done), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def encoded(docs: DataFrame, model_file: str = MODEL, specials: bool = True, column: str = "tokens") -> DataFrame:
    """``docs`` with its text's token ids in ``column`` (an input column of that name gives way)."""
    rest = docs.drop(column)
    schema = rest.select("*", F.lit(None).cast("array<int>").alias("tokens")).schema
    return rest.mapInArrow(_batches(Automaton(model_file), specials, rest.columns, False), schema).withColumnRenamed("tokens", column)


def decoded(docs: DataFrame, model_file: str = MODEL, column: str = "tokens", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids in ``column`` spell in ``text`` (an input column of that name gives way);
    null ids give a null text."""
    automaton, rest = Automaton(model_file), docs.drop(text)
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(automaton)
        for batch in batches:
            out = [None if x is None else encoder.decode(np.array(x, np.int64)) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, text])
    return rest.mapInArrow(run, rest.select("*", F.lit(None).cast("string").alias(text)).schema)


def token_digests(docs: DataFrame, model_file: str = MODEL, specials: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: digests of the ids as little-endian unsigned 32-bit
    integers, and of the text decoded from them in UTF-8."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(_batches(Automaton(model_file), specials, ["doc_id"], True),
                             "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
