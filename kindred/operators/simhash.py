"""Weighted SimHash signatures.

`simhash_agg` folds any table of weighted, hashed tokens in one aggregation with map-side combine.
`signatures` signs class rows, whose tokens lie in the row: no shuffle, one Arrow pass. `word_votes` and
`word_signature` do so for an array of words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.functions.hashing import murmur3_of
from kindred.schema import ACCESS_FLAGS, FRAMEWORK_PREFIXES, SIGNATURE
from kindred.session import ship

#: Sums of weights that differ by less are equal: the order of adding up decides no bit.
TIE = 1e-9


def simhash_agg(tokens: DataFrame, keys: list[str], hash_col: str = "h", weight: str = "w", name: str = "simhash") -> DataFrame:
    """One row per key: bit b is set iff the weights of tokens with the bit exceed those without."""
    votes = [F.sum(F.when(F.shiftright(F.col(hash_col), b).bitwiseAND(1) == 1, F.col(weight)).otherwise(-F.col(weight))).alias(f"_b{b}") for b in range(32)]
    bits = F.lit(0).cast("long")
    for b in range(32):
        bits = bits + F.when(F.col(f"_b{b}") > 0, F.lit(1 << b)).otherwise(F.lit(0))
    return tokens.groupBy(*keys).agg(*votes).select(*keys, bits.cast("long").alias(name))


#: Tokens whose votes are summed at once.
BLOCK_TOKENS = 1 << 16
#: Distinct tokens of a batch up to which their weights are summed first, each row's in as many places, and then make votes.
FEW_TOKENS = 32
#: What a signature is made of, by name; of methods and fields an array of each.
_SIGNED = ("access", "superclass", "interfaces", "methods.arg_count", "methods.return_type", "methods.xref_count", "methods.instr_count", "methods.abstract", "methods.calls", "fields.type_desc", "fields.access")


class _Votes:
    """Summed votes of a batch of classes: four parts with 32 bits each."""

    def __init__(self, n: int):
        self.n, self.sums = n, np.zeros((4, n, 32))

    @staticmethod
    def ballots(tokens: list[str]) -> np.ndarray:
        """A row for each token: 1 where its hash has the bit, else -1."""
        hashes = murmur3_of(pa.array(tokens, pa.string()))
        return np.where((hashes[:, None] >> np.arange(32)) & 1, 1.0, -1.0)

    def add(self, part: int, prefix: str, row: np.ndarray, values: pa.Array, weight: np.ndarray) -> None:
        """Tokens of these values, whose rows ascend; nulls have none. Each distinct one is hashed once."""
        there = values.is_valid().to_numpy(zero_copy_only=False)
        coded = values.filter(pa.array(there)).dictionary_encode()
        ballots, code = self.ballots([f"{prefix}{v}" for v in coded.dictionary.to_pylist()]), coded.indices.to_numpy(zero_copy_only=False)
        row, weight = row[there], weight[there]
        if len(ballots) <= FEW_TOKENS:
            counts = np.bincount(row * len(ballots) + code, weight, self.n * len(ballots)).reshape(self.n, len(ballots))
            self.sums[part] += counts @ ballots
            return
        for lo in range(0, len(code), BLOCK_TOKENS):
            own = row[lo : lo + BLOCK_TOKENS]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            self.sums[part][own[starts]] += np.add.reduceat(ballots[code[lo : lo + BLOCK_TOKENS]] * weight[lo : lo + BLOCK_TOKENS, None], starts, axis=0)

    def add_letters(self, row: np.ndarray, texts: pa.Array, weight: np.ndarray) -> None:
        """Tokens of the letters of category strings: votes are made of weighted counts of each letter."""
        plain = texts.fill_null("").to_pylist()
        points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(0, np.int64)
        size = np.array([len(t) for t in plain], np.int64)
        place = np.repeat(row, size) * len(kinds) + np.searchsorted(kinds, points)
        counts = np.bincount(place, np.repeat(weight, size), self.n * len(kinds)).reshape(self.n, len(kinds))
        self.sums[3] += counts @ self.ballots([f"op={k - 97}" for k in kinds])


def _framework(values: pa.Array) -> pa.Array:
    """The values that name what is of a framework; null in place of others."""
    coded = values.dictionary_encode()
    kept = pa.array([v if v is not None and v.startswith(FRAMEWORK_PREFIXES) else None for v in coded.dictionary.to_pylist()], pa.string())
    return kept.take(coded.indices)


def _class_votes(columns: dict[str, pa.Array]) -> np.ndarray:
    """Votes of classes, part by part: shape and hierarchy, fields, method prototypes, code. columns: those of _SIGNED."""
    n = len(columns["access"])
    votes, row = _Votes(n), np.arange(n)
    number = lambda x: x.fill_null(0).to_numpy(zero_copy_only=False)

    def listed(name: str) -> tuple[np.ndarray, pa.Array]:
        own = columns[name]
        return np.repeat(row, own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), own.flatten()

    even = lambda rows, w=1.0: np.full(len(rows), w)
    for name, of in (("nmethods", "methods.arg_count"), ("nfields", "fields.access")):
        votes.add(0, f"{name}=", row, columns[of].value_lengths().fill_null(0), even(row))
    access = number(columns["access"])
    for bit, name in ACCESS_FLAGS.items():
        has = np.flatnonzero(access & bit)
        votes.add(0, "access=", has, pa.array([name] * len(has), pa.string()), even(has))
    votes.add(0, "super=", row, _framework(columns["superclass"]), even(row, 4.0))
    faces, names = listed("interfaces")
    votes.add(0, "iface=", faces, _framework(names), even(faces, 3.0))
    fields, types = listed("fields.type_desc")
    votes.add(1, "ftype=", fields, types, even(fields))
    votes.add(1, "fstatic=", fields, pa.array(np.where(number(listed("fields.access")[1]) & 8, "True", "False"), pa.string()), even(fields))
    methods, instructions = listed("methods.instr_count")
    heavy = np.log2(2.0 + instructions.cast(pa.float64()).to_numpy(zero_copy_only=False))
    for prefix, name in (("margs=", "arg_count"), ("mret=", "return_type"), ("mxref=", "xref_count")):
        votes.add(2, prefix, methods, listed(f"methods.{name}")[1], heavy)
    votes.add_letters(methods, listed("methods.abstract")[1], heavy)
    calls = listed("methods.calls")[1]
    of = np.repeat(np.arange(len(methods)), calls.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    votes.add(3, "call=", methods[of], _framework(calls.flatten()), heavy[of] * 3.0)
    return votes.sums


def abstract_methods(methods: Column) -> Column:
    """Methods with their category strings, filled in where they are null."""
    return F.transform(methods, lambda m: m.withField("abstract", F.coalesce(m["abstract"], S.categorize(m["bytecode"]))))


def with_abstract(classes: DataFrame) -> DataFrame:
    """Fills in the methods' category strings where they are null."""
    return classes.withColumn("methods", abstract_methods(F.col("methods")))


def signatures(classes: DataFrame, name: str = "sig") -> DataFrame:
    """Adds the four-part signature of each class row; methods must have their category strings.

    Only what is signed goes to Python, a column for each field; tokens are made there, each distinct one of a batch once.
    """
    ship(classes.sparkSession)
    weight = 1 << np.arange(32, dtype=np.int64)

    def run(*columns: pa.Array) -> pa.Array:
        bits = (_class_votes(dict(zip(_SIGNED, columns))) > TIE) @ weight
        return pa.StructArray.from_arrays([pa.array(bits[i]) for i in range(4)], names=list(S.SIGNATURE_PARTS))

    # a field of an array of structs is the array of that field
    return classes.withColumn(name, F.arrow_udf(run, SIGNATURE)(*[F.col(c) for c in _SIGNED]))


#: Words whose votes are summed at once; sums of so many ones fit 16 bits.
BLOCK_WORDS = 1 << 14
_digests: dict[tuple[str, str], bytes] = {}


def _ballots(words: list[str], salts: tuple[str, ...]) -> np.ndarray:
    """A row for each word: for each salt 32 votes, lowest bit first, 1 where the bit of its salted MD5's first 32 bits is set, else -1."""
    if len(_digests) > 1_000_000:
        _digests.clear()
    out = []
    for salt in salts:
        for word in words:
            if (salt, word) not in _digests:
                _digests[salt, word] = hashlib.md5((salt + word).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[3::-1]
            out.append(_digests[salt, word])
    bits = np.unpackbits(np.frombuffer(b"".join(out), np.uint8).reshape(len(salts), len(words), 4), axis=2, bitorder="little")
    return (bits.astype(np.int16) * 2 - 1).transpose(1, 0, 2).reshape(len(words), 32 * len(salts))


def _voted(bags: pa.Array, salts: tuple[str, ...]) -> np.ndarray:
    """Summed votes of each bag of words, a row each."""
    votes = np.zeros((len(bags), 32 * len(salts)), np.int64)
    sizes = np.asarray(bags.value_lengths().fill_null(0), np.int64)
    coded = bags.flatten().dictionary_encode()
    ballots, code = _ballots(coded.dictionary.to_pylist(), salts), np.asarray(coded.indices)
    row = np.repeat(np.arange(len(bags)), sizes)
    for lo in range(0, len(code), BLOCK_WORDS):
        own = row[lo : lo + BLOCK_WORDS]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        votes[own[starts]] += np.add.reduceat(ballots[code[lo : lo + BLOCK_WORDS]], starts, axis=0)
    return votes


def word_votes(words: Column, salts: tuple[str, ...]) -> Column:
    """array<bigint> of an array of words: what simhash_agg sums, 32 votes for each salt."""

    def run(bags: pa.Array) -> pa.Array:
        votes = _voted(bags, salts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(votes) + 1) * votes.shape[1], pa.int32()), pa.array(votes.ravel()))

    return F.arrow_udf(run, "array<bigint>")(words)


def word_signature(words: Column, salts: dict[str, str]) -> Column:
    """struct of 32-bit signatures, by name, of an array of words hashed behind a salt each. Row-local: no word is shuffled."""
    names = tuple(salts)
    weight = 1 << np.arange(32, dtype=np.int64)

    def run(bags: pa.Array) -> pa.Array:
        bits = (_voted(bags, tuple(salts.values())).reshape(len(bags), len(names), 32) > 0) @ weight
        return pa.StructArray.from_arrays([pa.array(bits[:, i]) for i in range(len(names))], names=list(names))

    return F.arrow_udf(run, f"struct<{', '.join(f'{n}:bigint' for n in names)}>")(words)


def signed_words(rows: DataFrame, key: str, words: str, salts: dict[str, str], repeated: DataFrame) -> DataFrame:
    """rows with `sig` of their words; rows of a key in `repeated` (key) bear the signature of all words of that key."""
    ship(rows.sparkSession)
    own = rows.withColumn("sig", word_signature(F.col(words), salts))
    if repeated.isEmpty():
        return own
    again = F.broadcast(repeated.select(F.col(key).alias("_key"))) if repeated.limit(MOST_REPEATED + 1).count() <= MOST_REPEATED else repeated.select(F.col(key).alias("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    votes = rows.join(again, same, "left_semi").select(key, word_votes(F.col(words), tuple(salts.values())).alias("_v"))
    sums = votes.groupBy(key).agg(*[F.sum(F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(32 * len(salts))])
    bits = lambda n: sum((F.when(F.col(f"_{32 * n + b}") > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(32)), F.lit(0).cast("long"))
    told = sums.select(F.col(key).alias("_key"), F.struct(*[bits(n).alias(name) for n, name in enumerate(salts)]).alias("sig"))
    return own.join(again, same, "left_anti").unionByName(rows.join(told, same).select(*rows.columns, "sig"))


#: Keys of more than one row that are broadcast.
MOST_REPEATED = 100_000
