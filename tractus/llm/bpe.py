"""Byte-pair encoding through a tokenization automaton.

The merges are compiled in rank order. The automaton starts with one state in which every base symbol loops.
The gadget of a merge (a, b) -> c splits the state reached by ``a`` (the copy loses its ``b`` arc, and all ``a``
arcs are redirected to it), and gives each state with an ``a`` arc into the old state a ``c`` arc to where ``b`` led.
All arcs of one label lead to one state, so a state is named by the label that enters it, and what the gadgets leave
behind is kept as three tables: the two halves of each label, the step that made it, and the step that cut a pair.
``_arc(x, y)`` reads off whether the finished automaton has a ``y`` arc in the state of ``x``: either the arc was cut,
or the newer of both states/arcs is traced back to what its gadget copied it from. Answers are stored.

A word has exactly one path through the automaton. It is read symbol by symbol, all arcs that are partly read at once:
a ``Place`` holds the label that ends there and those arcs. Places are made and linked when a word first needs them, so
the table of moves fills with what texts use, and most words are read by look-ups alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_schema, bounded_batches, resident


#: Arcs that are stored; the table is emptied when it is full, and fills again from the gadgets.
KNOWN_ARCS = 400_000
#: Places that are stored, likewise.
KNOWN_PLACES = 100_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


# Where the tokenizers library's character tables are of other Unicode versions than Python's and regex's.
#: Assigned later than the library's tables of letters and numbers; it counts them as neither.
LATER = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb "
    "\U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 "
    "\U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 "
    "\U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 "
    "\U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 "
    "\U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
).replace(" ", "")
#: Marks that the library's composition does not know: they end what is composed, and are not moved.
UNKNOWN_MARKS = (
    "\u07fd \u0898-\u089f \u08ca-\u08d3 \u09fe \u0c3c \u0d3b-\u0d3c \u0eba \u1715 \u1abf-\u1ace \u1df6-\u1dfa \ua82c \U00010d24-\U00010d27 "
    "\U00010eab-\U00010eac \U00010efd-\U00010eff \U00010f46-\U00010f50 \U00010f82-\U00010f85 \U00011070 \U0001133b \U0001145e "
    "\U00011839-\U0001183a \U00011930 \U0001193d-\U0001193e \U00011943 \U000119e0 \U00011a34 \U00011a47 \U00011a99 \U00011d42 \U00011d44-\U00011d45 "
    "\U00011d97 \U00011f41-\U00011f42 \U00016ff0-\U00016ff1 \U0001e08f \U0001e130-\U0001e136 \U0001e2ae \U0001e2ec-\U0001e2ef \U0001e4ec-\U0001e4ef"
).replace(" ", "")
#: Lower case that only the library knows: (first, last, lower case of the first).
LOWER_CASE = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_MARKS = re.compile(f"([{UNKNOWN_MARKS}])")
_BEYOND = re.compile("[^\0-\xff]+")
_LOWERED = {a + i: to + i for a, b, to in LOWER_CASE for i in range(b - a + 1)}
#: Lower case of the first 256 characters, which stay among them; composition changes none of these.
_LATIN = bytes(ord(chr(i).lower()) for i in range(256))


def beyond(text: str) -> str:
    """The characters after the first 256; all that is special above is among them, so a search need not read the others."""
    return "".join(_BEYOND.findall(text))


def normalised(text: str) -> str:
    """Composed and in lower case, as the library does it: character by character, without a final sigma."""
    if text.isascii():
        return text.lower()
    parts = _MARKS.split(text) if _MARKS.search(beyond(text)) else [text]
    text = "".join([unicodedata.normalize("NFC", x) for x in parts]).replace("Σ", "σ")
    return (text if _LOWERED.keys().isdisjoint(map(ord, set(beyond(text)))) else text.translate(_LOWERED)).lower()


class Place(dict):
    """Where a reader is after a symbol: moves by next symbol; open: pairs of (trie node, state that the arc left), flat."""

    __slots__ = ("automaton", "open", "label", "length")

    def __init__(self, automaton: Automaton, open: tuple, label: int = -1, length: int = 0):
        self.automaton, self.open, self.label, self.length = automaton, open, label, length

    def __missing__(self, symbol: str) -> Place:
        to = self[symbol] = self.automaton.move(self.open, symbol)
        return to


class Automaton:
    """vocab: label -> id; merges: pairs of labels in rank order; end: what marks a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        self.end = end
        self.ids = vocab
        self.labels = {i: t for t, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        for step, pair in enumerate(merges, 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.gadget(step, vocab[a], vocab[b], vocab[a + b])
        symbols = {t: i for t, i in vocab.items() if i in self.made or len(t.removesuffix(end) if end else t) == 1}
        # Trie of all labels by symbol; a word's last symbol has the end mark.
        self.trie: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int]] = [(-1, 0)]
        for t, i in symbols.items():
            marked = end and t.endswith(end)
            t = t.removesuffix(end) if marked else t
            at = 0
            for s in (*t[:-1], t[-1] + end if marked else t[-1]):
                if s not in self.trie[at]:
                    self.trie[at][s] = len(self.trie)
                    self.trie.append({})
                    self.ends.append((-1, 0))
                at = self.trie[at][s]
            self.ends[at] = (i, len(t))
        self.places: dict[tuple, Place] = {}
        self.start = Place(self, (0, -1))

    def gadget(self, step: int, a: int, b: int, c: int) -> None:
        """Nothing happens where no b arc is left in the state of a, or where c is there already."""
        if c not in self.made and self._arc(a, b, step - 1):
            self.cut[a, b] = step
            self.left[c], self.right[c], self.made[c] = a, b, step

    def _arc(self, x: int, y: int, now: int = 1 << 60) -> bool:
        made, cut = self.made, self.cut
        while True:
            if cut.get((x, y), now + 1) <= now:
                return False
            tx, ty = made.get(x, 0), made.get(y, 0)
            if not tx and not ty:
                return True
            if tx >= ty:  # the state of x was, until its gadget, that of its right half
                now, x, y = tx - 1, self.right[x], self.left[y] if x == y else y
            else:  # the arc y came to every state with an arc of its left half
                now, y = ty, self.left[y]

    def move(self, open: tuple, symbol: str) -> Place:
        """The place after one more symbol. Of the arcs that are whole then, the automaton has one; shorter ones come first."""
        trie, ends, arcs = self.trie, self.ends, self.arcs
        label, length, to = -1, 0, []
        pairs = iter(open)
        for at, x in zip(pairs, pairs, strict=True):
            if (at := trie[at].get(symbol)) is None:
                continue
            if label < 0 and (y := ends[at][0]) >= 0:
                ok = True
                if x >= 0 and (ok := arcs.get(x << 32 | y)) is None:
                    if len(arcs) >= KNOWN_ARCS:
                        arcs.clear()
                    ok = arcs[x << 32 | y] = self._arc(x, y)
                if ok:
                    label, length = ends[at]
            if trie[at]:
                to += (at, x)
        to = (*((0, label) if label >= 0 else ()), *to)
        if (place := self.places.get(to)) is None:
            if len(self.places) >= KNOWN_PLACES:
                for p in (self.start, *self.places.values()):
                    p.clear()
                self.places.clear()
            place = self.places[to] = Place(self, to, label, length)
        return place

    def encode(self, word: str) -> list[int]:
        """word: byte symbols. The labels of its path, read off from the end."""
        if not word:
            return []
        place, path = self.start, []
        for s in word[:-1]:
            place = place[s]
            path.append(place)
        path.append(place[word[-1] + self.end])
        out, j = [], len(word)
        while j:
            place = path[j - 1]
            if place.label < 0:
                raise ValueError(f"not in the vocabulary: {word!r}")
            out.append(place.label)
            j -= place.length
        return out[::-1]

    def decode(self, path) -> str:
        """Emits the labels of the arcs; without a decoder of its own the vocabulary's labels are joined by spaces."""
        return " ".join(map(self.labels.__getitem__, path))


class Encoder:
    """A tokenizer file: normaliser, splitting pattern, automaton and special labels."""

    def __init__(self, spec: dict):
        model = spec["model"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.automaton.labels |= {i: t for t, i in special.items()}
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        pattern = split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # White space, letters and numbers as the tokenizer's own pattern engine has them.
        space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        later = f"[{LATER}]"
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^{space}\p{{L}}\p{{N}}]|{later})")
        pattern = pattern.replace(r"[\p{L}]", rf"(?!{later})\p{{L}}").replace(r"[\p{N}]", rf"(?!{later})\p{{N}}")
        self.words = regex.compile(pattern.replace(r"(?!%s)\p{L}+" % later, r"(?:(?!%s)\p{L})+" % later))
        self.fast = regex.compile(split.replace(r"\s", space))
        self.later = re.compile(later)
        # The same for the first 256 characters, whose classes are short enough to be spelled out.
        for name, members in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", f"[{space}]")):
            split = split.replace(name, "".join([rf"\x{i:02x}" for i in range(256) if regex.match(members, chr(i))]))
        self.latin = re.compile(split)
        self.symbols = byte_symbols()
        self.paths = Memo(self._path, 250_000)

    def _path(self, word: str) -> tuple[int, ...]:
        plain = word.isascii() and word.isalnum()  # such bytes stand for themselves
        return tuple(self.automaton.encode(word if plain else "".join([self.symbols[b] for b in word.encode()])))

    def _words(self, text: str) -> list[str]:
        try:
            return self.latin.findall(text.encode("latin-1").translate(_LATIN).decode("latin-1"))
        except UnicodeEncodeError:
            text = normalised(text)
            return (self.words if self.later.search(beyond(text)) else self.fast).findall(text)

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.paths.__getitem__, self._words(text))))

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(map(text.__contains__, self.special)):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids) -> str:
        return self.automaton.decode(ids)


def load(content: str) -> Encoder:
    """One compiled encoder per Python worker and vocabulary."""
    return resident(("bpe", hash(content)), lambda: Encoder(json.loads(content)))


def encode_decode(docs: DataFrame, tokenizer: str, column: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds each text's token ids (array<int>) and the text that they decode to.

    tokenizer: path of a BPE vocabulary file, read on the driver (a fixed file of a few MB, so it may be broadcast).
    Null and empty texts have no ids and decode to ''. Other columns are kept, whatever they hold; a column named as
    an output is replaced. Rows are independent: repeated rows are encoded alike, an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in docs.columns if c not in (ids, decoded)]
    at = names.index(column)

    def run(batches):
        encoder = load(content.value)
        for b in batches:
            paths = [encoder.encode(t) if t else [] for t in b.column(at).to_pylist()]
            texts = [encoder.decode(p) for p in paths]
            cols = [b.column(i) for i in range(b.num_columns)] + [pa.array(paths, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, ids, decoded])

    ddl = ", ".join([*arrow_schema(docs, names), f"`{ids}` array<int>", f"`{decoded}` string"])
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, ddl)


def op9(docs: DataFrame, tokenizer: str) -> DataFrame:
    coded = encode_decode(docs.select("doc_id", "text"), tokenizer)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
