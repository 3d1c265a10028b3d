"""Language-model scoring by a weighted backoff automaton.

The model is an interpolated n-gram model with Dirichlet smoothing: P(w | h) = (c(hw) + mu * P(w | h')) / (c(h) + mu), where
h' is h without its first word; below the unigrams stands the base distribution (c + 0.5) / (N + 0.5 (V + 1)). As an
automaton: every known context is a state; a known n-gram is an arc that bears its whole log probability; everything else
goes through the state's failure arc, of weight mu / (c(h) + mu), to the state of h'.

Spark runs it in three passes, none of which holds the whole model anywhere:
1. `blocks`: documents become blocks of bounded size, written as token codes and the block's word hashes.
2. `totals`: each block sends the distinct n-grams it holds, with their counts in its training documents, to shards by hash
   range; a shard adds up and answers every block for exactly the n-grams that the block asked for. There are as many shards
   as keep each one's n-grams within SHARD_BYTES, so a shard's task doesn't grow with the corpus, and only pairs of a block
   and a shard that share n-grams make a row: never more rows than n-grams. Of a hash go as many bits
   as the corpus needs, sorted and packed (4 to 6 bytes each), counts deflated.
3. `score`: each block builds the part of the automaton that its own texts can reach, and walks it from left to right, its
   texts in segments side by side. A segment starts a context's length early, after which an n-gram automaton's state is
   that of the whole text.

Words are known by 64-bit hashes, n-grams by as many of their first bits as hash_bits() says. Contract: a null text counts as empty (only the end token); repeated rows are scored each
on its own and each counts for training; a null doc_id is hashed as the text "null"; an empty table gives an empty table;
other columns stay unread.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, hashes_of, mix, saved, shuffle_partitions, spans_of, text_array, trim, words_of

#: Longest n-gram.
ORDER = 3
MU = 100.0
FOLDS, HELD_OUT = 5, 1
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
SPARE_BITS = 16
SEGMENT = 512
END_HASH = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)

BLOCK = "block long, doc_ids binary, held_out binary, lengths binary, codes binary, words binary, tokens long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per block of documents."""

    def run(batches):
        from pyspark import TaskContext

        first, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush():
            nonlocal number, held, size
            table = pa.Table.from_batches(held)
            texts = text_array(table.column("text"))
            codes, words, offsets = words_of(texts)
            lengths = np.diff(offsets) + 1
            tokens = np.full(int(lengths.sum()), len(words), dtype=np.uint32)
            stays = np.ones(len(tokens), dtype=bool)
            stays[np.cumsum(lengths) - 1] = False
            tokens[stays] = codes
            ids = table.column("doc_id").to_pylist()
            out = [zlib.crc32(str("null" if i is None else i).encode()) % FOLDS == HELD_OUT for i in ids]
            hashes = np.append(hashes_of(words, 0), END_HASH)
            # The most frequent words get the smallest codes, of which all but the first byte deflate to little.
            frequent = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(frequent), dtype=np.uint32)
            rank[frequent] = np.arange(len(frequent))
            tokens, hashes = rank[tokens], hashes[frequent]
            known = np.array([i is not None for i in ids], dtype=bool)
            values = np.array([i or 0 for i in ids], dtype=np.int64)
            row = [first + number, np.concatenate([values, known.astype(np.int64)]).tobytes(), np.array(out, dtype=bool).tobytes(), lengths.astype(np.int64).tobytes(), zlib.compress(tokens.view(np.uint8).reshape(-1, 4).T.tobytes(), 1), hashes.tobytes(), len(tokens)]
            number, held, size = number + 1, [], 0
            trim()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], names=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for part in by_bytes(batch, "text", block_bytes):
                if held and size + part.nbytes > block_bytes:
                    yield flush()
                held.append(part)
                size += part.nbytes
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCK)


class Block:
    """The texts of one block and its distinct n-grams, sorted by hash."""

    def __init__(self, row, order: int):
        ids = np.frombuffer(row["doc_ids"], dtype=np.int64)
        self.ids, self.has_id = ids[: len(ids) // 2], ids[len(ids) // 2 :].astype(bool)
        self.held_out = np.frombuffer(row["held_out"], dtype=bool)
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        self.tokens = np.ascontiguousarray(np.frombuffer(zlib.decompress(row["codes"]), dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
        words = np.frombuffer(row["words"], dtype=np.uint64)[self.tokens]
        at = spans_of(self.lengths)
        train = np.repeat(~self.held_out, self.lengths)
        self.grams, self.of, self.counts, self.last = [], [], [], []
        whole = words
        for n in range(1, order + 1):
            if n > 1:
                with np.errstate(over="ignore"):
                    whole = mix(np.concatenate([np.zeros(1, np.uint64), whole[:-1]]) * STEP + words)
            here = np.flatnonzero(at >= n - 1)
            grams, first, of = np.unique(whole[here], return_index=True, return_inverse=True)
            self.grams.append(grams)
            self.counts.append(np.bincount(of, weights=train[here], minlength=len(grams)).astype(np.int64))
            full = np.full(len(words), -1, dtype=np.int32)  # the n-gram that ends at each token
            full[here] = of
            self.of.append(full)
            self.last.append(here[first])  # a place where each n-gram ends


def packed(values: np.ndarray) -> bytes:
    """Counts, of which nearly all are below 255, in a deflated byte each; the rest stand before them with their places."""
    large = np.flatnonzero(values >= 255)
    body = zlib.compress(np.minimum(values, 255).astype(np.uint8).tobytes(), 1)
    sizes = np.array([len(values), len(large), len(body)], dtype=np.int64)
    return b"".join([sizes.tobytes(), large.astype(np.int64).tobytes(), values[large].astype(np.int64).tobytes(), body])


def unpacked(data: bytes) -> tuple[np.ndarray, int]:
    """(counts, bytes read)."""
    n, m, size = np.frombuffer(data, dtype=np.int64, count=3).tolist()
    large, exact = np.frombuffer(data, dtype=np.int64, count=2 * m, offset=24).reshape(2, m)
    body = 24 + 16 * m
    values = np.frombuffer(zlib.decompress(data[body : body + size]), dtype=np.uint8, count=n).astype(np.int64)
    values[large] = exact
    return values, body + size


def dense(values: np.ndarray, bits: int) -> bytes:
    """Sorted numbers of so many bits: the high bits of all in unary, the low bits of each as they are; about two bits more for each number than it must have."""
    n = len(values)
    high = min(bits, max(0, n.bit_length() - 1))
    low = bits - high
    unary = np.zeros(n + (1 << high), dtype=np.uint8)
    unary[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    rest = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low]
    return np.uint32(n).tobytes() + np.packbits(unary).tobytes() + np.packbits(rest, bitorder="little").tobytes()


def sparse(data: bytes, bits: int) -> np.ndarray:
    """The numbers that dense() wrote."""
    n = int(np.frombuffer(data, dtype=np.uint32, count=1)[0])
    high = min(bits, max(0, n.bit_length() - 1))
    low, size = bits - high, n + (1 << high)
    raw = np.frombuffer(data, dtype=np.uint8, offset=4)
    top = np.flatnonzero(np.unpackbits(raw[: (size + 7) // 8], count=size)) - np.arange(n)
    whole = np.zeros((n, 64), dtype=np.uint8)
    whole[:, :low] = np.unpackbits(raw[(size + 7) // 8 :], count=n * low, bitorder="little").reshape(n, low)
    return np.packbits(whole, axis=1, bitorder="little").view(np.uint64).ravel() | (top.astype(np.uint64) << np.uint64(low) if low < 64 else np.uint64(0))


def totals(made: DataFrame, order: int, power: int, size: int = 64) -> DataFrame:
    """Rows (block, shard, answers): training counts of what each block asked for, less its own; block -1 bears the shard's own sums. There are 2 ** power shards, and n-grams are told by the first `size` bits of their hashes, words by all 64."""
    fields = ", ".join(f"g{n} binary, c{n} binary" for n in range(1, order + 1))
    names = ["block", "shard", *[f"{x}{n}" for n in range(1, order + 1) for x in "gc"]]
    kinds = [pa.int64(), pa.int64()] + [pa.binary()] * (2 * order)
    sizes = [64] + [size] * (order - 1)

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order)
                shards = [(g >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(g), dtype=np.int64) for g in block.grams]
                inside = [(g >> np.uint64(64 - bits)) & np.uint64((1 << (bits - power)) - 1) for g, bits in zip(block.grams, sizes)]
                met = np.unique(np.concatenate(shards))
                columns = [[row["block"]] * len(met), met.tolist()]
                for grams, counts, shard, bits in zip(inside, block.counts, shards, sizes):
                    cuts = list(zip(met.tolist(), np.searchsorted(shard, met).tolist(), np.searchsorted(shard, met, side="right").tolist()))
                    columns.append([dense(grams[a:b], bits - power) for _, a, b in cuts])
                    columns.append([packed(counts[a:b]) for _, a, b in cuts])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
                del block, columns, shards, inside
                trim()

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        out = [[] for _ in range(len(rows))]
        sums = []
        shard = int(rows["shard"].iloc[0])
        for n in range(1, order + 1):
            grams = [sparse(x, sizes[n - 1] - power) for x in rows[f"g{n}"]]
            counts = np.concatenate([unpacked(x)[0] for x in rows[f"c{n}"]])
            keys, of = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(of, weights=counts, minlength=len(keys)).astype(np.int64)
            ends = np.cumsum([len(g) for g in grams])
            for k, (b, g) in enumerate(zip(ends, grams)):
                out[k].append(packed((total[of[b - len(g) : b]] - counts[b - len(g) : b])))
            sums += [int(total.sum()), int((total > 0).sum())]
        answers = [b"".join(some) for some in out]
        return pd.DataFrame({"block": [*rows["block"], -1], "shard": [shard] * (len(rows) + 1), "answers": [*answers, b""], "n": [0] * len(rows) + [sums[0]], "v": [0] * len(rows) + [sums[1]]})

    asked = made.select(*[c.split()[0] for c in BLOCK.split(", ")]).mapInArrow(ask, f"block long, shard long, {fields}")
    return asked.groupBy("shard").applyInPandas(answer, "block long, shard long, answers binary, n long, v long")


def shard_power(tokens: int, order: int, least: int) -> int:
    """The power of two that makes enough shards for `least` tasks and for SHARD_BYTES each, at 8 bytes for each token and length."""
    return max(0, (max(least, -(-8 * tokens * order // SHARD_BYTES)) - 1).bit_length())


def hash_bits(tokens: int, order: int) -> int:
    """So many bits that an n-gram is taken for another one with a probability of 2 ** -SPARE_BITS at most."""
    return min(64, max(1, tokens * order).bit_length() + SPARE_BITS)


class Automaton:
    """The part of the model that one block can reach. State 0 is the empty context; state `base[n] + k` the k-th n-gram of the block."""

    def __init__(self, block: Block, known: list[np.ndarray], n_all: int, v_all: int, mu: float):
        order = len(known)
        sizes = [1] + [len(g) for g in block.grams[: order - 1]]
        self.base = np.cumsum([0, *sizes])
        states = int(self.base[order])
        self.width = len(block.grams[0]) + 1
        self.fail = np.zeros(states, dtype=np.int64)
        self.weight = np.zeros(states)
        probability = (known[0] + 0.5) / (n_all + 0.5 * (v_all + 1))
        self.root = np.log10(probability)
        is_state = [np.ones(1, dtype=bool)]
        keys, scores, goes = [], [], []
        below, goto = probability, np.zeros(self.width, dtype=np.int64)  # of each (n-1)-gram: its probability, its state
        for n in range(1, order + 1):
            last = block.last[n - 1]
            word = block.of[0][last]
            there = known[n - 1] > 0
            state = np.where(there, self.base[n] + np.arange(len(there)), 0) if n < order else None
            if n == 1:
                p, to = probability, (state if order > 1 else np.zeros(len(there), dtype=np.int64))
                self.root_to = to
            else:
                context, suffix = block.of[n - 2][last - 1], block.of[n - 2][last]
                total = known[n - 2][context]
                p = (known[n - 1] + mu * below[suffix]) / (total + mu)
                to = np.where(there, state, goto[suffix]) if n < order else goto[suffix]
                keys.append((self.base[n - 1] + context[there]) * self.width + word[there])
                scores.append(np.log10(p[there]))
                goes.append(to[there])
            if n < order:
                at = self.base[n] + np.arange(len(there))
                self.weight[at] = np.log10(mu / (known[n - 1] + mu))
                self.fail[at] = 0 if n == 1 else goto[block.of[n - 2][last]]
                is_state.append(there)
            below, goto = p, to
        if keys:
            key = np.concatenate(keys)
            by = np.argsort(key, kind="stable")
            self.key, self.score, self.to = key[by], np.concatenate(scores)[by], np.concatenate(goes)[by]
        else:
            self.key = np.zeros(0, dtype=np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log probability) of each: along an arc, or through failure arcs until one is found."""
        score, to, todo = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64), np.arange(len(state))
        state = state.copy()
        while len(todo):
            at_root = state[todo] == 0
            rooted = todo[at_root]
            score[rooted] += self.root[word[rooted]]
            to[rooted] = self.root_to[word[rooted]]
            todo = todo[~at_root]
            if not len(todo):
                break
            key = state[todo] * self.width + word[todo]
            at = np.searchsorted(self.key, key)
            hit = at < len(self.key)
            hit[hit] = self.key[at[hit]] == key[hit]
            found = todo[hit]
            score[found] += self.score[at[hit]]
            to[found] = self.to[at[hit]]
            todo = todo[~hit]
            score[todo] += self.weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return to, score

    def walk(self, words: np.ndarray, lengths: np.ndarray, warm: int) -> np.ndarray:
        """The log probability of each text. Segments of all texts are walked side by side, each from its left end."""
        parts = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), parts)
        inside = spans_of(parts) * SEGMENT
        starts = (np.cumsum(lengths) - lengths)[text] + inside
        sizes = np.minimum(SEGMENT, lengths[text] - inside)
        state, score = np.zeros(len(text), dtype=np.int64), np.zeros(len(text))
        for k in range(-warm, int(sizes.max(initial=0))):
            live = np.flatnonzero((inside + k >= 0) & (k < sizes))
            if len(live):
                state[live], gain = self.step(state[live], words[starts[live] + k])
                if k >= 0:
                    score[live] += gain
        return np.bincount(text, weights=score, minlength=len(lengths))


def score_documents(docs: DataFrame, order: int = ORDER, mu: float = MU) -> DataFrame:
    """One row per document: its log10 probability under the model and under the base distribution."""
    spark = docs.sparkSession
    made = saved(blocks(docs), "lm-blocks")
    tokens = made.agg(F.sum("tokens")).first()[0] or 0
    told = saved(totals(made, order, shard_power(tokens, order, shuffle_partitions(spark)), hash_bits(tokens, order)), "lm-totals")
    sums = told.where("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_all, v_all = sums["n"] or 0, sums["v"] or 0

    def score(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for _, row in blocks.iterrows():
            block = Block(row, order)
            parts = [[] for _ in range(order)]
            for data in answers.sort_values("shard")["answers"]:
                for n in range(order):
                    values, size = unpacked(data)
                    parts[n].append(values)
                    data = data[size:]
            known = [np.concatenate(p) + own for p, own in zip(parts, block.counts)]
            machine = Automaton(block, known, n_all, v_all, mu)
            words, lengths = block.of[0], block.lengths
            text = np.repeat(np.arange(len(lengths)), lengths)
            each = lambda values: np.bincount(text, weights=values, minlength=len(lengths))
            ids = pd.array(block.ids, dtype="Int64")
            ids[~block.has_id] = pd.NA
            frames.append(pd.DataFrame({"doc_id": ids, "held_out": block.held_out, "n_tokens": lengths, "n_known": each(known[0][words] > 0).astype(np.int64), "train_tokens": n_all, "base_score": each(machine.root[words]), "score": machine.walk(words, lengths, order - 1)}))
            del block, machine, known, parts
            trim()
        return pd.concat(frames) if frames else pd.DataFrame(columns=[x.split()[0] for x in SCORED.split(", ")])

    sent = told.where("block >= 0").select("block", "shard", "answers")
    return made.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(score, SCORED)
