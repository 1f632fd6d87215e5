"""Language-model scores from a probabilistic suffix tree over words.

Symbols are lower-cased words and an end after each text.  The tree's root is
the smoothed distribution of single tokens; below it stand contexts of one to
``DEPTH`` preceding words.  Whatever occurs ``MIN_COUNT`` times in training rows is a
candidate, at every size of the corpus, so the tree grows with its input.  A
context is retained if its distribution diverges from that of its shorter
suffix: the gain in training log likelihood must exceed ``MIN_GAIN`` plus
``ENTRY_COST`` for each continuation it stores.  A token is scored in the longest retained
suffix of the words before it; continuations that a context doesn't store share
its remaining mass in proportion to the shorter suffix, so each distribution
sums to one.

Neither vocabulary nor tree is ever in one place.  Documents are dealt into
blocks, words and contexts into groups, all sized by the input.  Level by level
a block asks the groups for its distinct words and runs of words; the groups
count them over the whole corpus, decide which contexts stay and answer in the
order of the question, with a mark for each entry and counts and factors for
what stays.  A block finds its own runs again from its texts, so that nothing
travels twice; it walks down the levels and carries one probability a token.
With each question goes a sieve for the next level: 32 bits of the hash of each
run that may be an entry there, so that of runs that occur once in the corpus
(most of all) no more than that is sent.  What passes is counted exactly.

Defined results: a null or empty text is one token, the end; documents with a
null id are scored, not learned from; a very long text is counted and scored whole;
repeated rows are counted and scored each; ties don't arise; an empty table gives an
empty result; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.session import bounded_batches, crc_mod, settle, table
from veristrata.llm.words import Chunk, chunks, mix64

#: Words of the longest context.
DEPTH = 2
MIN_COUNT = 2
MIN_GAIN, ENTRY_COST = 3.0, 1.0
#: Pseudo-count of a context's unstored continuations.
NOVEL = 0.5
UNSEEN = 0.1
#: Characters of text in a block, and groups for each block.
BLOCK_CHARS = 8_000_000
GROUPS = 1
END = np.uint64(0x454E442D4F462D54)
#: Bytes of a run's hash in the sieve.
SIEVE_BYTES = 4


class Line:
    """The tokens of a chunk in order, an end after each text."""

    def __init__(self, chunk: Chunk):
        hashes = chunk.word_hash()
        self.hash = np.full(len(hashes) + chunk.n, END, np.uint64)
        self.hash[np.arange(len(hashes)) + chunk.doc] = hashes
        self.doc = np.repeat(np.arange(chunk.n), chunk.n_words + 1)


#: Upper bytes of a hash by which a context is told from others of its group (which has further bits), and a word from others after one context.
CONTEXT_BYTES, WORD_BYTES = 6, 5
#: A log10 probability travels as a multiple of 2**-34 in five bytes.
FIXED_BYTES, FIXED = 5, 2.0**34 * 2**24


def _packed(values: np.ndarray, width: int | None = None) -> bytes:
    """The numbers' bytes by place, upper ones first, at most ``width`` of them; the like lie together, so that they compress."""
    if values.dtype == bool:
        return np.packbits(values).tobytes() + bytes([-len(values) % 8])
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T[::-1]
    return planes[:width].tobytes()


def _unpacked(data: bytes, kind, width: int | None = None) -> np.ndarray:
    kind = np.dtype(kind)
    if kind == bool:
        return np.unpackbits(np.frombuffer(data[:-1], np.uint8), count=max(0, 8 * len(data) - 8 - data[-1])).astype(bool) if data else np.zeros(0, bool)
    width = width or kind.itemsize
    planes = np.zeros((len(data) // width, kind.itemsize), np.uint8)
    planes[:, ::-1][:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return planes.view(kind).reshape(-1)


def _fixed(logs: np.ndarray) -> np.ndarray:
    return np.rint(logs * (FIXED / 2**24)).astype(np.int64) << 24


def _arrays(rows: pa.Table, column: str, kind, width: int | None = None) -> list[np.ndarray]:
    return [_unpacked(x or b"", kind, width) for x in rows.column(column).to_pylist()]


def _all(rows: pa.Table, column: str, kind, width: int | None = None) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *_arrays(rows, column, kind, width)])


ASKED = "grp bigint, block bigint, ids binary, sizes binary, entries binary, names binary, counts binary, shorter binary, sieved binary, seen binary"
ANSWERED = "block bigint, level int, grp bigint, counts binary, often binary, kept binary, rests binary, maybe binary, v bigint, n bigint"


def _table(names: str, rows: list[dict]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit name of a context with a further word."""
    return mix64(context * np.uint64(0x9FB21C651E98DF25) + word)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(values, return_inverse=True)
    return distinct, which.astype(np.int32)


def _dealt(group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by group, by place within one, and where each group starts in it."""
    narrow = group.astype(np.uint16) if groups <= 1 << 16 else group
    return np.argsort(narrow, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group, minlength=groups))])


class Block:
    """A block's tokens, walked down the tree level by level.

    ``state`` is the place of the frequent context that ends at a token (-1: none) among those of
    the level, ``ids`` and ``sizes`` are these contexts' names and occurrences in training rows, and
    ``p`` is every token's log10 probability in its longest retained context so far.
    ``runs`` names the run of words that ends at a token, ``live`` marks those that the groups were asked of.
    """

    def __init__(self, texts: pa.Table, groups: int):
        hashes, docs = [], []
        for i, _, chunk in chunks(texts.column("raw"), lower=True):
            line = Line(chunk)
            hashes.append(line.hash)
            docs.append(line.doc + i)
        self.groups, self.n = groups, texts.num_rows
        self.doc = np.concatenate(docs).astype(np.int32)
        self.same = np.concatenate([[False], self.doc[1:] == self.doc[:-1]])
        self.hash = self.runs = np.concatenate(hashes)
        self.live = np.ones(len(self.hash), bool)
        self.names, self.which = _ranked(self.hash)
        self.order, self.starts = _dealt(self._group(self.names), groups)

    def _group(self, names: np.ndarray) -> np.ndarray:
        return (names % np.uint64(self.groups)).astype(np.int64)

    def weights(self, texts: pa.Table) -> np.ndarray:
        return texts.column("learn").to_numpy().astype(np.float64)[self.doc]

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=self.n)

    def take_words(self, answers: pa.Table, floor: float) -> None:
        """Start from the root: the corpus counts of the block's distinct tokens."""
        count = np.zeros(len(self.names), np.int64)
        count[self.order] = _all(answers, "counts", np.int64)
        self.p = (np.log10(count + UNSEEN) - floor)[self.which]
        self.known = count[self.which] > 0
        often = count >= MIN_COUNT
        self.state = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)[self.which]
        self.ids, self.sizes = self.names[often], count[often]
        self.word, self.words, self.word_counts = self.state, self.ids, self.sizes

    def lengthen(self) -> None:
        """Runs one word longer, where both that run's parts were asked of."""
        longer = np.zeros(len(self.runs), np.uint64)
        longer[1:] = _joined(self.runs[:-1], self.hash[1:])
        self.run_at = np.flatnonzero(self.same & self.live & np.roll(self.live, 1))
        self.runs = longer
        self.run_names, self.run_which = _ranked(longer[self.run_at])
        self.run_order, self.run_starts = _dealt(self._group(self.run_names), self.groups)

    def ask_sieve(self, learn: np.ndarray) -> dict[str, np.ndarray]:
        """What the groups need to mark the runs that may be frequent."""
        seen = np.bincount(self.run_which, weights=learn[self.run_at], minlength=len(self.run_names))
        return {"sieved": self.run_names[self.run_order], "seen": np.minimum(seen, 255).astype(np.uint8)[self.run_order]}

    def next_level(self, answers: pa.Table) -> None:
        """Find the level's entries among the runs that passed the sieve: frequent contexts with a next word whose own suffix is frequent too."""
        self.before = np.roll(self.state, 1)
        self.before[~self.same] = -1
        maybe = np.zeros(len(self.run_names), bool)
        maybe[self.run_order] = _all(answers, "maybe", bool)
        some = np.zeros(len(maybe), np.int64)
        some[self.run_which] = self.run_at
        entry = maybe & (self.before[some] >= 0) & (self.state[some] >= 0)
        inside = entry[self.run_which]
        self.at = self.run_at[inside]
        self.which = (np.cumsum(entry, dtype=np.int32) - 1)[self.run_which[inside]]
        self.live = np.zeros(len(self.doc), bool)
        self.live[self.at] = True
        self.names, self.context, self.last = self.run_names[entry], self.before[some[entry]], self.word[some[entry]]
        self.context_order, self.context_starts = _dealt(self._group(self.ids), self.groups)
        place = np.empty(len(self.ids), np.int32)
        place[self.context_order] = np.arange(len(self.ids), dtype=np.int32)
        self.order = np.argsort(place[self.context], kind="stable")
        entries = np.bincount(self.context, minlength=len(self.ids)).astype(np.int64)[self.context_order]
        self.starts = np.concatenate([[0], np.cumsum(entries)])[self.context_starts]

    def ask(self, level: int, learn: np.ndarray) -> dict[str, np.ndarray]:
        """What the groups need of each context and of each entry, in the order of the groups."""
        counts = np.bincount(self.which, weights=learn[self.at], minlength=len(self.names)).astype(np.int64)
        if level == 1:
            shorter = self.word_counts[self.last]
        else:
            shorter = np.zeros(len(self.names))
            shorter[self.which] = self.p[self.at]
            shorter = _fixed(shorter)
        entries = np.bincount(self.context, minlength=len(self.ids)).astype(np.int32)
        of_context = {"ids": self.ids, "sizes": self.sizes, "entries": entries}
        of_entry = {"names": self.words[self.last], "counts": counts, "shorter": shorter}
        return {k: x[self.context_order] for k, x in of_context.items()} | {k: x[self.order] for k, x in of_entry.items()}

    def take(self, answers: pa.Table) -> None:
        """Go down one level by the groups' answers."""
        m = len(self.names)
        often, kept, times, rest = np.zeros(m, bool), np.zeros(len(self.ids), bool), np.zeros(m, np.int64), np.zeros(len(self.ids))
        often[self.order], kept[self.context_order] = _all(answers, "often", bool), _all(answers, "kept", bool)
        times[self.order[often[self.order]]] = _all(answers, "counts", np.int64)
        rest[self.context_order[kept[self.context_order]]] = _all(answers, "rests", np.int64, FIXED_BYTES) / FIXED
        inside = np.flatnonzero(self.before >= 0)
        self.p[inside] += rest[self.before[inside]]
        own = np.log10(np.maximum(times, 1) / (self.sizes[self.context] + NOVEL))
        stored = (often & kept[self.context])[self.which]
        self.p[self.at[stored]] = own[self.which[stored]]
        found = often[self.which]
        self.state = np.full(len(self.doc), -1, np.int32)
        self.state[self.at[found]] = (np.cumsum(often) - 1)[self.which[found]]
        self.ids, self.sizes = self.names[often], times[often]

    def walk(self, answers: pa.Table, levels: int, floor: float) -> None:
        """From the texts alone to the place where ``levels`` levels below the root are known, and the next one's runs."""
        answers = answers.sort_by("grp")
        of_level = [answers.filter(pc.equal(answers.column("level"), k)) for k in range(levels + 1)]
        self.take_words(of_level[0], floor)
        for k in range(1, levels + 1):
            self.lengthen()
            self.next_level(of_level[k - 1])
            self.take(of_level[k])


#: Of a question: what there is one of for each context, and the bytes sent of a number if not all.
OF_CONTEXT = ("ids", "sizes", "entries")
WIDTH = {"ids": CONTEXT_BYTES, "names": WORD_BYTES, "sieved": SIEVE_BYTES}


def _question(block: int, level: int, parts: list[tuple[dict[str, np.ndarray], np.ndarray]]) -> pa.Table:
    """A row for each group that is asked; ``parts`` are columns in the order of the groups with the groups' starts."""
    rows, widths = [], WIDTH | ({"shorter": FIXED_BYTES} if level > 1 else {})
    for g in np.flatnonzero(sum(np.diff(starts) for _, starts in parts)).tolist():
        packed = {k: _packed(x[starts[g] : starts[g + 1]], widths.get(k)) for columns, starts in parts for k, x in columns.items()}
        rows.append({"grp": g, "block": block} | packed)
    return _table(ASKED, rows)


def _ask_words(groups: int):
    """A block's distinct tokens with their occurrences in its training rows, dealt to their groups."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        block = Block(texts, groups)
        learn = block.weights(texts)
        counts = np.bincount(block.which, weights=learn, minlength=len(block.names)).astype(np.int64)
        words = {"ids": block.names[block.order], "counts": counts[block.order]}
        block.lengthen()
        return _question(key[0].as_py(), 0, [(words, block.starts), (block.ask_sieve(learn), block.run_starts)])

    return run


def _maybe(asked: pa.Table) -> list[np.ndarray]:
    """Which of each block's runs may occur often enough over the whole corpus: all that do, and a few more."""
    sieved = _arrays(asked, "sieved", np.uint64, SIEVE_BYTES)
    distinct, which = np.unique((np.concatenate(sieved) >> np.uint64(32)).astype(np.uint32), return_inverse=True)
    often = np.bincount(which, weights=_all(asked, "seen", np.uint8), minlength=len(distinct)) >= MIN_COUNT
    return np.split(often[which], np.cumsum([len(x) for x in sieved])[:-1])


def _count_words(asked: pa.Table) -> pa.Table:
    """One group of tokens: its totals (without a block), and corpus counts for each block that asked."""
    names = _arrays(asked, "ids", np.uint64, CONTEXT_BYTES)
    distinct, which = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(which, weights=_all(asked, "counts", np.int64), minlength=len(distinct)).astype(np.int64)
    rows = [{"v": int((total > 0).sum()), "n": int(total.sum())}]
    parts = np.split(which, np.cumsum([len(x) for x in names])[:-1])
    for block, group, at, maybe in zip(asked.column("block").to_pylist(), asked.column("grp").to_pylist(), parts, _maybe(asked), strict=True):
        rows.append({"block": block, "level": 0, "grp": group, "counts": _packed(total[at]), "maybe": _packed(maybe)})
    return _table(ANSWERED, rows)


def _ask_level(level: int, groups: int, floor: float):
    """A block's frequent contexts of ``level`` words and their continuations, dealt to the contexts' groups."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts, groups)
        block.walk(answers, level - 1, floor)
        block.lengthen()
        block.next_level(answers.filter(pc.equal(answers.column("level"), level - 1)).sort_by("grp"))
        learn = block.weights(texts)
        asked = block.ask(level, learn)
        parts = [({k: asked[k] for k in OF_CONTEXT}, block.context_starts), ({k: asked[k] for k in asked if k not in OF_CONTEXT}, block.starts)]
        if level < DEPTH:
            block.lengthen()
            parts.append((block.ask_sieve(learn), block.run_starts))
        return _question(key[0].as_py(), level, parts)

    return run


def _fit_level(level: int, floor: float):
    """One group of contexts: decided over the whole corpus, answered to each block that asked."""

    def run(asked: pa.Table) -> pa.Table:
        ids, words = _arrays(asked, "ids", np.uint64, CONTEXT_BYTES), _arrays(asked, "names", np.uint64, WORD_BYTES)
        entries = _all(asked, "entries", np.int32)
        contexts, at, context = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        sizes = _all(asked, "sizes", np.int64)[at].astype(float)
        distinct, which = np.unique(_joined(np.repeat(np.concatenate(ids), entries), np.concatenate(words)), return_inverse=True)
        times = np.bincount(which, weights=_all(asked, "counts", np.int64), minlength=len(distinct)).astype(np.int64)
        often = times >= MIN_COUNT
        # What all blocks say of an entry is the same: any of them will do.
        theirs, shorter = np.zeros(len(distinct), np.int64), np.zeros(len(distinct))
        theirs[which] = np.repeat(context, entries)
        shorter[which] = np.log10(_all(asked, "shorter", np.int64) + UNSEEN) - floor if level == 1 else _all(asked, "shorter", np.int64, FIXED_BYTES) / FIXED
        good, rest = fit(theirs[often], times[often], sizes, shorter[often])
        # Deeper levels need every frequent continuation, the last one only those that are stored.
        wanted = often & good[theirs] if level == DEPTH else often
        out, c, e = [], 0, 0
        for block, group, own, after, maybe in zip(asked.column("block").to_pylist(), asked.column("grp").to_pylist(), ids, words, _maybe(asked), strict=True):
            mine, entry = context[c : c + len(own)], which[e : e + len(after)]
            c, e = c + len(own), e + len(after)
            kept, found = good[mine], wanted[entry]
            parts = {"counts": times[entry[found]], "often": found, "kept": kept, "maybe": maybe}
            out.append({"block": block, "level": level, "grp": group, "n": int(kept.sum()), "rests": _packed(_fixed(rest[mine[kept]]), FIXED_BYTES)} | {k: _packed(x) for k, x in parts.items()})
        return _table(ANSWERED, out)

    return run


def fit(context: np.ndarray, times: np.ndarray, size: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are retained, and log10 of the factor of what they don't store.

    An entry has its context's place, its occurrences and its log10 probability after the
    shorter suffix; ``size`` are the contexts' occurrences.
    """
    m = len(size)
    if not len(context):
        return np.zeros(m, bool), np.zeros(m)
    held = np.bincount(context, weights=times, minlength=m)
    mass = np.bincount(context, weights=10.0**shorter, minlength=m)
    entries = np.bincount(context, minlength=m)
    own = np.log10(times / (size[context] + NOVEL))
    left = np.log10((size - held + NOVEL) / (size + NOVEL)) - np.log10(np.maximum(1 - mass, 1e-9))
    gain = (np.bincount(context, weights=times * (own - shorter), minlength=m) + (size - held) * left) * np.log(10)
    good = (entries > 0) & (mass < 1 - 1e-9) & (gain >= MIN_GAIN + ENTRY_COST * entries)
    return good, np.where(good, left, 0.0)


def lm_scores(docs: DataFrame, learn, held_out, key: str = "doc_id") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score``; ``learn`` marks training rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    groups = GROUPS * blocks
    dealt = docs.select(F.pmod(F.xxhash64(key, text), F.lit(blocks)).alias("block"), F.coalesce(learn, F.lit(False)).alias("learn"), text.cast("binary").alias("raw"), F.col(key).alias("id"), held_out.alias("held_out"))
    texts = dealt.select("block", "learn", "raw").groupBy("block")
    answers = settle(texts.applyInArrow(_ask_words(groups), ASKED).groupBy("grp").applyInArrow(_count_words, ANSWERED), transient=True)
    v, n = answers.where("block is null").agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    floor = float(np.log10(n + UNSEEN * (v + 1)))
    answers, depth = answers.where("block is not null"), 0
    while depth < DEPTH:
        asked = texts.cogroup(answers.groupBy("block")).applyInArrow(_ask_level(depth + 1, groups, floor), ASKED)
        found = settle(asked.groupBy("grp").applyInArrow(_fit_level(depth + 1, floor), ANSWERED), transient=True)
        answers, depth = answers.unionByName(found), depth + 1
        if not found.agg(F.sum("n")).first()[0]:
            break
    kind = docs.schema[key].dataType.simpleString()

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts, groups)
        block.walk(answers, 0, floor)
        base, known = block.per_doc(block.p), block.per_doc(block.known).astype(np.int64)
        block.walk(answers, depth, floor)
        tokens = np.bincount(block.doc, minlength=block.n)
        names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([texts.column("id"), texts.column("held_out"), tokens, known, pa.array(np.full(texts.num_rows, n)), base, block.per_doc(block.p)], names=names)

    left = dealt.select("block", "id", "held_out", "raw").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(score, f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_mod("doc_id", 10)
    return lm_scores(table(spark, sf_dir, "documents"), part != 0, F.coalesce(part == 0, F.lit(False)))
