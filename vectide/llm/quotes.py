"""Chat formatting by quotation linking: quotes found in their originals, then removed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import in_bitmap, key_bitmap, ordered_parts, running_total
from .shingles import _BASE, mixed, word_hashes

_MARK = re.compile(r"[ \t]*>")
# quotes deeper than this are read as this deep
DEEPEST = 100
_NO_TURN = -(2**63)
# parts of a run of quoted lines with fewer words than this are quotes of whole lines only
LEAST_WORDS = 5
# every run of so many quoted words is looked for, too
RUN = 8
# starts a passage that counts as a whole run, paragraph or line only
_WHOLE = "\n"
# own words are handled together up to this many characters
BLOCK_CHARS = 2**18
_FILTER_BITS, _CHAT_BITS = 27, 24
# in scripts without spaces each character is a word
_UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
    "\U00020000-\U0003ffff"
)
_WORDS = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")


def quote_level(line: str) -> tuple[int, str]:
    """How many quote marks start a line, and what follows them."""
    level, at = 0, 0
    while level < DEEPEST and (mark := _MARK.match(line, at)):
        level, at = level + 1, mark.end()
    return level, line[at:].strip() if level else line


def normalised(text: str) -> str:
    """Lower case, white space collapsed: a quote may be wrapped anew."""
    return " ".join(text.lower().split())


def spoken(text: str) -> list[str]:
    """The words of a text in lower case, without punctuation."""
    return _WORDS.findall(text.lower())


class Passages:
    """What a message quotes, as `(level, passage)`, and which passages are its own words.

    Iteration gives the quoted passages, each once: per run of lines of one level its words,
    those of its paragraphs, lines and sentences, and all runs of RUN words. A message has
    such a passage at level 0 if its own words hold it anywhere, so part of a line, a quote
    that is wrapped anew and one that is edited in places are found. Paragraphs and lines of
    fewer than LEAST_WORDS words, and runs without any word, are marked by _WHOLE: only a
    whole run, paragraph or line says the same.
    """

    def __init__(self, text: str):
        runs: list[tuple[int, list[str]]] = []
        for line in text.split("\n"):
            level, rest = quote_level(line)
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(rest)
        self._own_runs = ["\n".join(lines) for level, lines in runs if not level]
        self.own = spoken("\n".join(self._own_runs))
        self.quoted: dict[tuple[int, str], None] = {}
        for level, lines in runs:
            if level:
                for unit in _units(lines):
                    self.quoted[level, unit] = None

    def short(self) -> set[str]:
        """Its own runs, paragraphs and lines that are marked by _WHOLE where quoted."""
        parts = ["\n".join(self._own_runs)]
        for run in self._own_runs:
            parts += [run, *re.split(r"\n\s*\n", run), *run.split("\n")]
        return {
            _WHOLE + unit
            for part in parts
            if len(spoken(part)) < LEAST_WORDS and (unit := normalised(part))
        }

    def __iter__(self) -> Iterator[tuple[int, str]]:
        return iter(self.quoted)

    def __contains__(self, passage: tuple[int, str]) -> bool:
        level, unit = passage
        if level:
            return passage in self.quoted
        if unit.startswith(_WHOLE):
            return unit in self.short()
        words = spoken(unit)
        return bool(words) and f" {' '.join(words)} " in f" {' '.join(self.own)} "


def _units(lines: list[str]) -> Iterator[str]:
    """The passages of one run of quoted lines."""
    run = "\n".join(lines)
    words = spoken(run)
    if words:
        yield " ".join(words)
    elif unit := normalised(run):
        yield _WHOLE + unit
    for k in range(len(words) - RUN + 1):
        yield " ".join(words[k : k + RUN])
    paragraphs = re.split(r"\n\s*\n", run)
    for part in [*paragraphs, *lines]:
        some = spoken(part)
        if len(some) >= LEAST_WORDS:
            yield " ".join(some)
        elif len(some) < len(words) and (unit := normalised(part)):
            yield _WHOLE + unit
    for paragraph in paragraphs:
        for sentence in _SENTENCE.split(normalised(paragraph)):
            if len(some := spoken(sentence)) >= LEAST_WORDS:
                yield " ".join(some)


def passages(text: str) -> Passages:
    """The passages of a message; level 0 is its own words."""
    return Passages(text)


def own_words(text: str) -> str:
    """A message without its quoted lines and the blank lines around them."""
    kept = [line for line in text.split("\n") if not quote_level(line)[0]]
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(kept)).strip()


def _geometric(base: int, count: int) -> np.ndarray:
    table = np.full(count, base, np.uint64)
    table[:1] = 1
    return np.multiply.accumulate(table)


class _Spans:
    """Hashes of any runs of a sequence of words, each by two lookups."""

    def __init__(self, words: list[str]):
        codes = word_hashes(" ".join(words).encode())
        sums = np.cumsum(codes * _geometric(int(_BASE), len(codes)), dtype=np.uint64)
        self._sums = np.concatenate([np.zeros(1, np.uint64), sums])
        self._back = _geometric(pow(int(_BASE), -1, 2**64), len(codes))

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        spans = (self._sums[at + size] - self._sums[at]) * self._back[at]
        return mixed(spans + np.asarray(size).astype(np.uint64))


def _in_chat(hashes: np.ndarray, chats: np.ndarray) -> np.ndarray:
    return mixed(hashes ^ mixed(chats.view(np.uint64))).view(np.int64)


def _whole_hashes(units: list[str]) -> np.ndarray:
    digests = (blake2b(unit.encode(), digest_size=8).digest() for unit in units)
    return np.array([int.from_bytes(d, "little") for d in digests], np.uint64)


_UNITS = "_conv string, _chat long, _turn long, level int, words int, _hash long, _chars int"


def _rows(batch: pa.RecordBatch, owner: np.ndarray, level, words, hashes, chars) -> pa.RecordBatch:
    place = pa.array(owner, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(c).take(place) for c in ("_conv", "_chat", "_turn")),
            pa.array(level, pa.int32()),
            pa.array(words, pa.int32()),
            pa.array(hashes, pa.int64()),
            pa.array(chars, pa.int32()),
        ],
        ["_conv", "_chat", "_turn", "level", "words", "_hash", "_chars"],
    )


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All quoted passages: their hash in the conversation and their size, 0 if marked."""
    for batch in batches:
        chats = batch.column("_chat").to_numpy(zero_copy_only=False)
        for k, text in enumerate(batch.column("text").to_pylist()):
            if not text or ">" not in text or not (units := list(passages(text))):
                continue
            marked = [unit.startswith(_WHOLE) for _, unit in units]
            sizes = np.array([0 if m else u.count(" ") + 1 for m, (_, u) in zip(marked, units)])
            hashes = np.zeros(len(units), np.uint64)
            if any(marked):
                hashes[marked] = _whole_hashes([u for m, (_, u) in zip(marked, units) if m])
            if not all(marked):
                some = np.flatnonzero(sizes)
                at = np.cumsum(sizes[some]) - sizes[some]
                spans = _Spans([units[j][1] for j in some])
                hashes[some] = spans.hashes(at, sizes[some])
            owner = np.full(len(units), k)
            yield _rows(
                batch,
                owner,
                [level for level, _ in units],
                sizes,
                _in_chat(hashes, chats[owner]),
                [len(unit) for _, unit in units],
            )


def _said(sizes: list[int], wanted: np.ndarray, quoting: np.ndarray) -> Callable:
    """Runs of own words, of `sizes`, whose hash is wanted, in conversations that quote."""

    def block(texts: list[str], chats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [passages(text) for text in texts]
        counts = np.array([len(f.own) for f in found])
        owner = np.repeat(np.arange(len(found)), counts)
        ends = np.cumsum(counts)[owner]
        spans = _Spans([word for f in found for word in f.own])
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        if 0 in sizes:
            short = [(k, unit) for k, f in enumerate(found) for unit in f.short()]
            own = np.array([k for k, _ in short], np.int64)
            hits.append((own, _in_chat(_whole_hashes([u for _, u in short]), chats[own])))
        every = np.arange(len(owner))
        starts = every
        for size in sizes:
            if size:
                # what is longer than RUN begins with a run of RUN words that is wanted itself
                at = starts if size > RUN else every
                at = at[at + size <= ends[at]]
                hashes = _in_chat(spans.hashes(at, size), chats[owner[at]])
                fit = in_bitmap(wanted, hashes)
                hits.append((owner[at[fit]], hashes[fit]))
                if size == RUN:
                    starts = at[fit]
        kept = [(own[fit := in_bitmap(wanted, h)], h[fit]) for own, h in hits]
        both = np.array([np.concatenate(part) for part in zip(*kept)], np.int64)
        return tuple(np.unique(both, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            chats = batch.column("_chat").to_numpy(zero_copy_only=False)
            held: list[int] = []
            chars = 0
            last = len(texts) - 1
            use = in_bitmap(quoting, chats)
            for k, text in enumerate(texts):
                if use[k] and text:
                    held.append(k)
                    chars += len(text)
                if held and (chars >= BLOCK_CHARS or k == last):
                    rows = np.array(held)
                    owner, hashes = block([texts[j] for j in held], chats[rows])
                    none = np.zeros(len(owner), np.int32)
                    yield _rows(batch, rows[owner], none, none, hashes, none)
                    held, chars = [], 0

    return run


def quote_units(rows: DataFrame) -> DataFrame:
    """Quoted passages, and at level 0 the own words that some message may quote.

    A bitmap of fixed size, made from the quoted passages, lets runs of own words through
    (an equal hash in the running maximum decides), so what nobody quotes is not shuffled.
    """
    rows = rows.select("_conv", F.xxhash64("_conv").alias("_chat"), "_turn", "text")
    quoted = cut(rows.mapInArrow(_quoted, _UNITS))
    sizes = sorted(row["words"] for row in quoted.select("words").distinct().collect())
    if not sizes:
        return quoted
    wanted = key_bitmap(quoted, "_hash", _FILTER_BITS)
    quoting = key_bitmap(quoted, "_chat", _CHAT_BITS)
    return quoted.unionByName(rows.mapInArrow(_said(sizes, wanted, quoting), _UNITS))


def _cleaned(columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = pa.array([own_words(text or "") for text in texts], pa.string())
            quoted = pa.array(
                [any(quote_level(line)[0] for line in (t or "").split("\n")) for t in texts]
            )
            yield pa.RecordBatch.from_arrays(
                [own if c == "text" else quoted if c == "quoted" else batch.column(c) for c in columns],
                columns,
            )

    return run


def link_quotes(units: DataFrame) -> DataFrame:
    """`(_conv, _turn, _linked)`: the turn each message quotes, where one is found.

    For each quoted passage the latest earlier message that holds it in its own words, by a
    running maximum over (conversation, passage hash) in turn order, so a passage that
    every message repeats is no hot group and makes no pairs. Among a message's originals
    the shallowest quote level counts, then the most quoted characters, then the latest.
    """
    rows = units.select("_conv", "_turn", "level", "_hash", "_chars").withColumn(
        "_own", F.when(F.col("level") == 0, F.col("_turn"))
    )
    # of one turn, quotes come before own words: nothing quotes itself
    order = [F.col("_turn"), F.col("level").desc()]
    parts = ordered_parts(rows, F.col("_conv"), F.col("_hash"), *order)
    found = running_total(parts, ["_conv", "_hash"], order, "_own", "_original", largest=True)
    return (
        found.filter("level > 0 and _original < _turn")
        .groupBy("_conv", "_turn", "_original")
        .agg(F.min("level").alias("_level"), F.sum("_chars").alias("_chars"))
        .groupBy("_conv", "_turn")
        .agg(F.max(F.struct(-F.col("_level"), "_chars", "_original")).alias("_best"))
        .select("_conv", "_turn", F.col("_best._original").alias("_linked"))
    )


def _depths(nodes: DataFrame) -> DataFrame:
    """Adds `depth` to `(_conv, _turn, _parent)`: the number of replies above a message.

    Pointers jump to their pointer's target, so a chain of n replies takes log2(n) rounds.
    """
    state = cut(
        nodes.select(
            "_conv",
            "_turn",
            "_parent",
            F.col("_parent").alias("_up"),
            F.when(F.col("_parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        )
    )
    while not state.filter("_up is not null").isEmpty():
        above = state.select(
            F.col("_conv").alias("_c"),
            F.col("_turn").alias("_t"),
            F.col("_up").alias("_next"),
            F.col("depth").alias("_more"),
        )
        state = cut(
            state.join(
                above, (F.col("_conv") == F.col("_c")) & (F.col("_up") == F.col("_t")), "left"
            ).select(
                "_conv",
                "_turn",
                "_parent",
                F.col("_next").alias("_up"),
                (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"),
            )
        )
    return state.select("_conv", "_turn", "_parent", "depth")


def reply_ordered(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per message, its quotes removed and its place in the reply order known.

    `(conversation, turn, role, quoted, linked, reply_to, depth, position, text, formatted)`.
    A message replies to the turn that it quotes (`linked`), else to the turn before it.
    `position` counts from 0 by depth of reply, then turn: every message comes after the one
    that it answers. `formatted` is the message between role markers; in the order of
    `position` they are the chat. Conversations are not collected into one row, since one may
    hold most of the table.

    Null text is empty. A null conversation is one of its own. Null turns come first, as
    one turn, and are answered by nothing but the next turn. Rows that repeat a turn
    share its links and are numbered one after the other. A null role is shown as "unknown".
    An empty table gives an empty one. Other columns are not read.
    """
    rows = df.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("")).alias(
            "_conv"
        ),
        F.coalesce(F.col(turn).cast("long"), F.lit(_NO_TURN)).alias("_turn"),
        F.col(conversation).cast("long").alias("conversation"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )
    linked = link_quotes(quote_units(rows))
    turns = ordered_parts(
        rows.select("_conv", "_turn").distinct(), F.col("_conv"), F.col("_turn")
    )
    before = running_total(
        turns, ["_conv"], [F.col("_turn")], "_turn", "_before", largest=True
    )
    nodes = before.join(linked, ["_conv", "_turn"], "left")
    nodes = cut(
        nodes.select(
            "_conv",
            "_turn",
            F.coalesce("_linked", "_before").alias("_parent"),
            F.col("_linked").isNotNull().alias("linked"),
        )
    )
    depths = _depths(nodes)
    columns = ["_conv", "_turn", "conversation", "role", "text", "quoted"]
    clean = rows.mapInArrow(
        _cleaned(columns),
        "_conv string, _turn long, conversation long, role string, text string, quoted boolean",
    )
    placed = (
        clean.join(depths, ["_conv", "_turn"])
        .join(nodes.select("_conv", "_turn", "linked"), ["_conv", "_turn"])
        .withColumn("_one", F.lit(1).cast("long"))
    )
    order = [F.col("depth"), F.col("_turn"), F.col("role"), F.col("text")]
    parts = ordered_parts(placed, F.col("_conv"), *order)
    known = F.col("_turn") != _NO_TURN
    return running_total(parts, ["_conv"], order, "_one", "position").select(
        F.col("conversation").alias(conversation),
        F.when(known, F.col("_turn")).alias(turn),
        "role",
        "quoted",
        "linked",
        F.when(F.col("_parent") != _NO_TURN, F.col("_parent")).alias("reply_to"),
        "depth",
        "position",
        "text",
        F.concat(
            F.lit("<|"),
            F.coalesce("role", F.lit("unknown")),
            F.lit("|>\n"),
            F.col("text"),
            F.lit("\n"),
        ).alias("formatted"),
    )
