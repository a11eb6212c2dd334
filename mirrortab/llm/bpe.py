"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last one of its encoding.  The candidates
are the tokens that end there, which a suffix automaton of the reversed problem hands out longest
first; a candidate stands if the encoding of what is before it ends in a token that may be followed
by it.  Two tokens may stand side by side if merging their joined text keeps the border between
them: the merge that closes each side must come before every merge that would cross the border.
Following the last tokens back from the end of the word gives the ids.  No merge is ever replayed
over a text.

The suffix automaton is over the vocabulary's strings.  Reading a word through it gives, at each
position, the longest piece that ends there and occurs in some token; the tokens that end there are
the ones on the state's suffix links.

The vocabulary is one that is given; it is read on the driver from a path that is a parameter and
broadcast (a vocabulary file is a few MB whatever the size of the corpus, and ``MODEL_BYTES`` is
enforced).

Defined results: null is read as the empty text, which has no tokens; special strings in a text
become their special token, as the tokenizer file says; words of any length are encoded in time
proportional to their length times the longest suffix chain; repeated rows are each encoded; other
columns are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mirrortab.llm.automaton import SuffixAutomaton
from mirrortab.llm.common import query, table

#: Largest vocabulary file that is broadcast.
MODEL_BYTES = 64_000_000
#: Encoded words a worker remembers in each of two generations; the older one is forgotten.
REMEMBERED = 200_000
#: Longest word that is remembered.
REMEMBERED_CHARS = 48

#: The splitting rules of the vocabulary file, and white space as its rules mean it.  Fixed values.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Model:
    """A vocabulary file with word ends, and what the dynamic program looks up.

    A symbol is a byte, plus 256 at the end of a word.  ``rank`` is the place of the merge that
    makes a token, -1 for the single symbols.
    """

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        byte = {shown: b for b, shown in enumerate(byte_symbols())}
        ids = model["vocab"]
        self.names = {i: name for name, i in ids.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: name for name, i in self.specials.items()})
        special = set(self.specials)

        def symbols(name: str) -> tuple:
            if name.endswith(end):
                *front, back = (byte[c] for c in name[: -len(end)])
                return (*front, back + 256)
            return tuple(byte[c] for c in name)

        keys = {i: symbols(name) for name, i in ids.items() if name not in special}
        self.size = {i: len(k) for i, k in keys.items()}
        self.rank = dict.fromkeys(keys, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for place, (a, b) in enumerate(model["merges"]):
            left, right, made = ids[a], ids[b], ids[a + b]
            self.halves[made] = left, right
            self.rank[made] = self.merge_rank[left, right] = place
        self.pairs: dict[tuple[int, int], bool] = {}
        #: tokens that merging really makes of their own text
        made = {i for i in keys if i not in self.halves}
        for token in sorted(self.halves, key=self.rank.__getitem__):
            left, right = self.halves[token]
            if left in made and right in made and self._border_stays(left, right, self.rank[token]):
                made.add(token)
        automaton = SuffixAutomaton()
        for token in made:
            automaton.add(keys[token])
        self.arrows, link = automaton.next, automaton.link
        self.link, self.length = link, automaton.length
        token_at = [-1] * len(link)
        for token in made:
            token_at[automaton.state_of(keys[token])] = token
        #: per state, the tokens that end its strings, longest first; shared along the link chain
        self.ending: list[tuple] = [()] * len(link)
        for state in sorted(range(1, len(link)), key=self.length.__getitem__):
            shorter = self.ending[link[state]]
            self.ending[state] = (token_at[state], shorter) if token_at[state] >= 0 else shorter
        self.split = regex.compile(PIECES)
        self.spaces = regex.compile(SPACES)
        self.odd = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the file's rule does not
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def forget(self) -> None:
        """Drop what was remembered, so that an idle worker holds the model only."""
        self.young, self.old = {}, {}
        self.pairs.clear()

    def _border_stays(self, left: int, right: int, limit: int) -> bool:
        """No merge across the border has a rank below that of the merge it would have to precede.

        The merges at both sides are undone from the latest to the earliest.  While the border is
        between two parts, a pair across it that merges earlier than the merge just undone would
        have been taken first.  Equal ranks are taken from left to right.
        """
        while True:
            if self.merge_rank.get((left, right), limit) < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a > b:
                limit, left = a, self.halves[left][1]
            elif b >= 0:
                limit, right = b + 1, self.halves[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self._border_stays(left, right, 1 << 60)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one piece: the last token of every prefix, then the way back."""
        n = len(word)
        last = [0] * (n + 1)
        arrows, link, length, ending, size = self.arrows, self.link, self.length, self.ending, self.size
        known, compatible = self.pairs.get, self.compatible
        state = matched = 0
        for i in range(1, n + 1):
            symbol = word[i - 1] if i < n else word[i - 1] + 256
            while (target := arrows[state].get(symbol)) is None:
                state = link[state]
                matched = length[state]
            state = target
            matched += 1
            chain = ending[state]
            while True:
                token, chain = chain
                k = size[token]
                if k > matched:
                    continue
                if k == i:
                    break
                before = last[i - k]
                fits = known((before, token))
                if fits or fits is None and compatible(before, token):
                    break
            last[i] = token
        ids = []
        while n:
            ids.append(last[n])
            n -= size[last[n]]
        ids.reverse()
        return ids

    def _chunk(self, chunk: str) -> tuple:
        ids: list[int] = []
        for piece in self.split.findall(chunk):
            ids += self.encode_word(piece.encode("utf-8", "surrogatepass"))
        found = tuple(ids)
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def _plain(self, text: str, ids: list[int]) -> None:
        """Ids of text without special strings, appended."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # character by character, as the file's rule: a capital sigma has one small form
        if "\u03a3" in text:
            text = text.replace("\u03a3", "\u03c3")
        # no piece holds white space, so only where it separates matters
        chunks = self.spaces.split(text.lower()) if self.odd.search(text) else text.lower().split()
        young, old, more = self.young, self.old, ids.extend
        for chunk in chunks:
            found = young.get(chunk)
            if found is None:
                found = old.get(chunk)
                if found is None:
                    found = self._chunk(chunk)
                    young, old = self.young, self.old
                elif len(young) < REMEMBERED:
                    young[chunk] = found
            more(found)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        at = 0
        if self.cut is not None:
            for special in self.cut.finditer(text):
                self._plain(text[at : special.start()], ids)
                ids.append(self.specials[special[0]])
                at = special.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def decode(self, ids) -> str:
        """The tokens' names joined by blanks: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


_MODELS: dict[int, tuple] = {}


def model_of(shared) -> Model:
    """The model of a broadcast definition, built once in a worker."""
    definition = shared.value
    if id(definition) not in _MODELS:
        _MODELS.clear()
        _MODELS[id(definition)] = Model(definition), definition
    return _MODELS[id(definition)][0]


def vocabulary(spark: SparkSession, path: str):
    """Broadcast a vocabulary file after a check of its size."""
    with open(path, encoding="utf-8") as file:
        definition = file.read(MODEL_BYTES + 1)
    if len(definition) > MODEL_BYTES:
        raise ValueError(f"{path} holds more than {MODEL_BYTES} characters")
    return spark.sparkContext.broadcast(definition)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column of token ids and, if it is named, a column of what they decode to.

    Columns of those names are replaced.  Both are made in one pass, by one model in a worker.
    """
    shared = vocabulary(docs.sparkSession, path)
    new = [(ids, T.ArrayType(T.IntegerType())), *([(decoded, T.StringType())] if decoded else [])]
    kept = docs.drop(*[name for name, _ in new])
    where, columns = kept.columns.index(text), kept.columns
    kinds = [f.dataType for f in kept.schema.fields] + [kind for _, kind in new]
    numbered = T.StructType([T.StructField(str(i), kind) for i, kind in enumerate(kinds)])

    def run(frames):
        model = model_of(shared)
        for batch in frames:
            for part in slices(batch, where):
                found = [model.encode(t.as_py()) for t in part.column(where)]
                made = [pa.array(found, pa.list_(pa.int32()))]
                if decoded:
                    made.append(pa.array([model.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], numbered.names)
        model.forget()

    return kept.mapInArrow(run, numbered).toDF(*columns, *[name for name, _ in new])


def decode(tokens: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``tokens`` with the decoded text of its column of ids; null stays null."""
    shared = vocabulary(tokens.sparkSession, path)
    kept = tokens.drop(decoded)
    where, columns = kept.columns.index(ids), kept.columns
    numbered = T.StructType(
        [T.StructField(str(i), f.dataType) for i, f in enumerate(kept.schema.fields)]
        + [T.StructField("decoded", T.StringType())]
    )

    def run(frames):
        model = model_of(shared)
        for batch in frames:
            found = [None if x is None else model.decode(x) for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], numbered.names)

    return kept.mapInArrow(run, numbered).toDF(*columns, decoded)


def slices(batch: pa.RecordBatch, where: int, limit: int = 4_000_000):
    """Parts of a batch whose texts hold about ``limit`` bytes at most (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(where)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Per document: the number of tokens, a digest of the ids, a digest of what they decode to.

    Ids and decoded texts are made by the functions of :func:`encode` and :func:`decode`, in one
    pass, so that a corpus of ids need not go through Arrow twice.
    """
    shared = vocabulary(docs.sparkSession, path)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    )

    def run(frames):
        model = model_of(shared)
        shown = {i: str(i) for i in model.names}.__getitem__
        digest = lambda value: hashlib.sha256(value.encode("utf-8")).hexdigest()
        for batch in frames:
            counts, of_ids, of_text = [], [], []
            for part in slices(batch, 1):
                for text in part.column(1).to_pylist():
                    ids = model.encode(text)
                    counts.append(len(ids))
                    of_ids.append(digest(" ".join(map(shown, ids))))
                    of_text.append(digest(model.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], schema.names
            )
        model.forget()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), default_path())
