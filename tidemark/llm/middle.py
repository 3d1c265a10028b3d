"""Fill-in-middle transformation over an index of distinct texts.

Identical texts are one entry of the index: Spark groups by the whole text, so contents themselves are compared, and no two
entries are equal. Documents are joined to their entry by the SHA-256 of their text. For each entry the places where its
code points begin, in bytes, are listed once, as it meets the first of its documents, which follow each other: an Elias-Fano
list of about two bits for each code point, with a directory of how many set bits come before each block, so the byte of any
code point is found without decoding the text. Each document selects the two bytes where its own seeded cut falls; what it
puts together is parsed back, and must have that SHA-256 again.

Texts move once, to the index; documents travel as an id and a digest. A text with very many documents is parted: its entry
goes to as many parts as it needs, and its documents are dealt over them. Such texts are fewer than MOST_HOT whatever the
number of documents, since each has more than one in MOST_HOT of all rows; their list is broadcast.

Contract: a null text is an empty one and has form plain; a text that contains a mark is plain too; a null doc_id seeds as
the word null; repeated rows are rows of their own with the same cut if their ids are equal; ties do not arise, for a cut
depends on id and text alone; an empty table gives an empty table; other columns stay unread.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, saved

#: Fixed values of the output format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Texts of more than LEAST_HOT documents and more than one in MOST_HOT of all of them are parted.
LEAST_HOT, MOST_HOT = 256, 20_000
#: Bytes of the bits that one entry of the directory covers.
BLOCK = 64
BATCH_BYTES = 4 << 20


def low_bits(values: int, universe: int) -> int:
    """How many low bits of each of so many values, up to universe, an Elias-Fano list keeps apart."""
    return max(0, (universe // values).bit_length() - 1) if values else 0


def boundary_list(raw: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(code points, high, low, directory) of a text's UTF-8 bytes: where each code point begins, and the end of the text."""
    places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    n, low = len(places), low_bits(len(places), len(raw))
    bits = np.zeros((len(raw) >> low) + n + 1, dtype=np.uint8)
    bits[(places >> low) + np.arange(n)] = 1
    high = np.packbits(bits, bitorder="little")
    ones = np.add.reduceat(np.bitwise_count(high).astype(np.int64), np.arange(0, len(high), BLOCK))
    lower = np.packbits(((places[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel(), bitorder="little")
    return n - 1, high.tobytes(), lower.tobytes(), (np.cumsum(ones) - ones).tobytes()


def select(k: int, universe: int, points: int, high: bytes, lower: bytes, directory: bytes) -> int:
    """The k-th place of a boundary list: the k-th set bit of the high part, found by the directory, and its low bits."""
    low = low_bits(points + 1, universe)
    before = np.frombuffer(directory, dtype=np.int64)
    block = int(np.searchsorted(before, k, side="right")) - 1
    bits = np.unpackbits(np.frombuffer(high, dtype=np.uint8, count=min(BLOCK, len(high) - BLOCK * block), offset=BLOCK * block), bitorder="little")
    at = 8 * BLOCK * block + int(np.flatnonzero(bits)[k - before[block]])
    place = at - k << low
    for b in range(low):
        bit = k * low + b
        place |= (lower[bit >> 3] >> (bit & 7) & 1) << b
    return place


def text_index(texts: DataFrame) -> DataFrame:
    """texts (digest, text) to (digest, text, copies): one row for each distinct text."""
    return texts.groupBy("digest", "text").agg(F.count("*").alias("copies"))


def assemble(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join([p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle])


def restored(form: str, output: bytes) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    first, second = (p, s) if form == "psm" else (s, p)
    head, middle = output[len(first) :].split(m)
    one, two = head.split(second)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def cut(key: int | None, text: bytes, entry: tuple[int, bytes, bytes, bytes], seed: int) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points of prefix, of middle, output) of one document."""
    points = entry[0]
    drawn = sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[8 * k : 8 * k + 8], 16) for k in range(4))
    if not points or h3 % 100 >= PLAIN_FROM or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    first, second = sorted((h1 % (points + 1), h2 % (points + 1)))
    a, b = (select(k, len(text), *entry) for k in (first, second))
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    return form, first, second - first, assemble(form, text[:a], text[a:b], text[b:])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, hot: tuple[int, int] = (LEAST_HOT, MOST_HOT), outputs: bool = True) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output) for every row of docs; output, the text as it is trained on, is left out on demand."""
    whole = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    keyed = whole.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    limit = max(hot[0], docs.count() // hot[1])
    crowded = keyed.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    crowded = F.broadcast(saved(crowded.select("digest", F.ceil(F.col("n") / limit).cast("int").alias("parts")), "hot-texts"))
    rare = keyed.join(crowded, "digest", "left_anti")
    often = keyed.join(crowded, "digest")
    # The exchange by digest serves both the grouping and the join.
    met = rare.select("id", "digest").join(text_index(rare.select("digest", "text").repartition("digest")), "digest")
    dealt = often.select("id", "digest", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "parts").cast("int").alias("part"))
    entries = text_index(often.select("digest", "text")).join(crowded, "digest").select("digest", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met, shared = met.select("id", "digest", "text"), dealt.join(entries, ["digest", "part"]).select("id", "digest", "text")
    kind = docs.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * outputs

    def run(batches):
        names = [key, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
        last, entry = None, None
        for batch in batches:
            for some in by_bytes(batch, "text", BATCH_BYTES):
                texts = some.column("text").cast(pa.large_binary()).to_pylist()
                rows = []
                for k, (digest, raw) in enumerate(zip(some.column("digest").to_pylist(), texts)):
                    if digest != last:
                        last, entry = digest, boundary_list(np.frombuffer(raw, dtype=np.uint8))
                    form, prefix, middle, output = cut(some.column("id")[k].as_py(), raw, entry, seed)
                    again = sha256(restored(form, output))
                    if again.digest() != digest:
                        raise ValueError(f"document {some.column('id')[k]}: its output doesn't give its text back")
                    rows.append((entry[0], form, prefix, middle, sha256(output).hexdigest(), again.hexdigest(), *[output] * outputs))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.string()] * outputs]
                arrays = [some.column("id"), *[pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    # A merged join gives rows in this order already; it lets an entry's list be made once for all documents that follow.
    whole = [rows.sortWithinPartitions("digest").mapInArrow(run, shape) for rows in (met, shared)]
    return whole[0].union(whole[1])


#: The query's rows in SQL.
ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS s FROM documents),
drawn AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM docs),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts"""
