r"""Fill-in-middle documents by a two-pass streaming matcher.

A text is cut into units, the matches of a pattern from left to right (here every code point); what
lies between two matches belongs to the unit before. A first pass advances a lazy iterator over the
matches and counts them, holding none. The ranks at which prefix and middle end follow from the count
and the document's id; a second iterator is advanced to the smaller and then to the larger one, and
what it stops at says where the text is cut. No array of units or of their places is ever stored: beside
the text and its output the memory does not grow with the text.

    plain   the text
    psm     <P> prefix <S> suffix <M> middle
    spm     <S> suffix <P> prefix <M> middle

`restore` rebuilds the text from the output and its form alone: the markers are not in the text (such
texts stay plain), and no marker can begin within another one, so each is found where it first occurs.

Row-local, no shuffle.

Defined results: a null text is empty; empty texts, and those that hold a marker, are plain; a null id
counts as an empty string of digits. Repeated rows are transformed alike. A column named like an output is
replaced. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import columns, fresh, others, widened
from kindred.session import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Every code point is a unit.
CODE_POINT = r"(?s:.)"
#: Texts a batch of outputs is made of, in characters.
BATCH_CHARS = 4 << 20


def n_units(unit: re.Pattern, text: str) -> int:
    """The first pass: how many units there are. Nothing but a counter is kept."""
    counter = count()
    deque(zip(unit.finditer(text), counter), maxlen=0)
    # zip takes a match before a number, so no number is lost where the matches end
    return next(counter)


def cuts(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """The second pass: the places in the text where its units number `low` and `high` (low <= high, from 0) begin; its end beyond the last."""
    matches = unit.finditer(text)
    begun = next(islice(matches, low, None), None)
    first = len(text) if begun is None else begun.start() if low else 0
    if high == low:
        return first, first
    begun = next(islice(matches, high - low - 1, None), None)
    return first, len(text) if begun is None else begun.start()


def draws(doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits that follow from the id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(unit: re.Pattern, text: str, doc_id: int | None, plain_percent: int, spm_percent: int) -> tuple[int, str, str | None, str | None, str]:
    """(number of units, form, prefix, middle, output)."""
    n = n_units(unit, text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    a, b = h1 % (n + 1), h2 % (n + 1)
    first, second = cuts(unit, text, min(a, b), max(a, b))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_percent:
        return n, "spm", prefix, middle, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", prefix, middle, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text of which `output` was made."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"not a {form} output")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, restored string"
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def fill_in_middle(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: str = CODE_POINT, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """df's columns without `text`, with n (units), form, prefix_chars and middle_chars (code points; null if plain),
    output, and restored: the text as it is rebuilt from output and form."""
    ship(df.sparkSession)
    names = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")
    kept = others(df, text, *names)
    body, number = fresh(df, "_text"), fresh(df, "_number")

    def run(batches):
        pattern = re.compile(unit)
        for batch in batches:
            ids, column = batch.column(number), batch.column(body)
            begin, chars, out = 0, 0, [[] for _ in names]
            for i in range(batch.num_rows):
                n, form, prefix, middle, output = transform(pattern, column[i].as_py() or "", ids[i].as_py(), plain_percent, spm_percent)
                row = (n, form, None if prefix is None else len(prefix), None if middle is None else len(middle), output, restore(output, form))
                for col, x in zip(out, row):
                    col.append(x)
                chars += len(output)
                if chars >= BATCH_CHARS or i == batch.num_rows - 1:
                    cols = [batch.column(c).slice(begin, i + 1 - begin) for c in kept]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, t) for x, t in zip(out, _TYPES))], names=[*kept, *names])
                    begin, chars, out = i + 1, 0, [[] for _ in names]

    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    return df.select(*columns(df, kept), quoted(doc_id).cast("long").alias(number), quoted(text).alias(body)).mapInArrow(run, widened(df, kept, SCHEMA))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, its code points as units."""
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
with d as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::varchar, '')) x from documents),
h as (select doc_id, t, length(t) n, ('0x' || x[1:8])::bigint h1, ('0x' || x[9:16])::bigint h2, ('0x' || x[17:24])::bigint h3, ('0x' || x[25:32])::bigint h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end f from h),
p as (select *, substring(t, 1, a) pre, substring(t, a + 1, b - a) mid, substring(t, b + 1) suf from c)
select doc_id, n::bigint n, f form, case when f <> 'plain' then a end prefix_chars, case when f <> 'plain' then b - a end middle_chars,
  sha256(case f when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256,
  sha256(t) restored_sha256
from p
"""
