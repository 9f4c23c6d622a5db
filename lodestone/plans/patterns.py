"""Many patterns against many texts: Aho-Corasick automata over blocks of patterns, run once over each text.

Patterns are cut into blocks by hash so that none holds more than LIMIT bytes of them on average. One block is sent to all
tasks (its size is summed first), and texts stay where they are. Several blocks meet slices of the texts by cogrouping, so that
neither the patterns nor the texts are whole anywhere; a text is then read once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.components import cut

LIMIT = 8 << 20  # bytes of patterns in a block
SLICE = 64 << 20  # bytes of texts in a slice that meets one of several blocks
PART = 4 << 20  # bytes of texts, or one text, that are read at once
#: Makes a function of one batch of texts from a block of patterns.
Matcher = Callable[[pa.Table], Callable[[pa.RecordBatch], pa.RecordBatch]]


def automaton(words: list[str]) -> ahocorasick.Automaton:
    """Finds all places of all words; a match tells the word's place in the list."""
    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        if w:
            found.add_word(w, i)
    found.make_automaton()
    return found


def parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of hardly more than PART bytes of text, as strings of Python and what is found in them take several times that."""
    start = held = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
        if held and held + (n or 0) > PART:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    yield batch.slice(start)


def matched(texts: DataFrame, text: str, patterns: DataFrame, width: str, matcher: Matcher, schema: T.StructType | str) -> DataFrame:
    """What the matcher gives for all texts and all patterns. width: column with a pattern's bytes, for its own use only.

    A matcher has to give the same for a block of patterns whatever else is in it.
    """
    held = cut(patterns, "patterns")
    total = held.agg(F.sum(width)).first()[0] or 0
    blocks = max(1, -(-int(total) // LIMIT))
    if blocks == 1:
        sent = texts.sparkSession.sparkContext.broadcast(held.drop(width).toArrow())  # LIMIT bytes of patterns at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = None
            for batch in batches:
                find = find or matcher(sent.value)
                yield from map(find, parts(batch, text))

        return texts.mapInArrow(run, schema)
    slices = max(1, -(-int(texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SLICE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts.withColumn("text_slice", F.pmod(F.xxhash64(text, F.rand(1)), F.lit(slices)).cast("int")).withColumn("pattern_block", every(blocks))
    right = held.withColumn("pattern_block", F.pmod(F.xxhash64(*held.columns), F.lit(blocks)).cast("int")).withColumn("text_slice", every(slices)).drop(width)
    by = ["text_slice", "pattern_block"]
    if not isinstance(schema, T.StructType):
        schema = T.StructType.fromDDL(schema)
    names = schema.fieldNames()

    def meet(some: pa.Table, block: pa.Table) -> pa.Table:
        if not some.num_rows or not block.num_rows:
            return pa.Table.from_batches([], schema=empty)
        find = matcher(block.drop_columns(by))
        return pa.Table.from_batches([find(p) for b in some.drop_columns(by).to_batches() for p in parts(b, text)]).select(names).cast(empty)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)


def contained(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, group: str | None = None, whole_words: bool = False) -> DataFrame:
    """key, pattern (and group): the distinct patterns that each text contains.

    group: patterns are looked for only in texts with the same value of this column of both. whole_words: no letter, digit or _
    stands right before or behind. Nulls and empty patterns are found nowhere.
    """
    columns = [pattern, *([group] if group else [])]
    some = patterns.filter(F.coalesce(pattern, F.lit("")) != "").select(*columns).distinct().withColumn("pattern_bytes", F.octet_length(pattern))
    of_texts = [key, text, *([group] if group and group not in (key, text) else [])]
    rows = texts.filter(F.col(text).isNotNull()).select(*dict.fromkeys(of_texts))
    schema = T.StructType([rows.schema[key], T.StructField(pattern, T.StringType()), *([rows.schema[group]] if group and group != key else [])])

    def matcher(block: pa.Table):
        words: dict = {}
        for row in zip(*[block.column(x).to_pylist() for x in columns]):
            words.setdefault(row[1] if group else None, []).append(row[0])
        machines = {g: (automaton(w), w) for g, w in words.items()}

        def find(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, groups = batch.column(key), batch.column(group).to_pylist() if group else [None] * batch.num_rows
            at, hits = [], []
            for i, (value, g) in enumerate(zip(batch.column(text).to_pylist(), groups)):
                machine, listed = machines.get(g, (None, []))
                if machine is None or not value:
                    continue
                seen = set()
                for end, w in machine.iter(value):
                    if w not in seen and (not whole_words or stands_alone(value, end + 1 - len(listed[w]), end + 1)):
                        seen.add(w)
                at += [i] * len(seen)
                hits += [listed[w] for w in seen]
            rows_at = pa.array(at, pa.int64())
            made = [keys.take(rows_at), pa.array(hits, pa.string()), *([batch.column(group).take(rows_at)] if group and group != key else [])]
            return pa.RecordBatch.from_arrays(made, names=schema.fieldNames())

        return find

    return matched(rows, text, some, "pattern_bytes", matcher, schema)


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no letter, digit or _ touches text[start:end]."""
    word = lambda c: c.isalnum() or c == "_"
    return not (start and word(text[start - 1])) and not (end < len(text) and word(text[end]))
