"""Token counts: Arrow functions encode batches that are balanced by bytes, cut long texts at safe boundaries, and return lengths only.

Contract: a null text counts as empty (0 tokens); no row is dropped; repeated rows are counted each on its own; other
columns stay unread. No text is truncated. An empty table gives an empty table.

Input partitions are balanced by bytes by Spark's file splits, and Arrow batches within them by `by_bytes`. The library
encodes a batch of strings at a time, which are
* the distinct white-space separated chunks of an Arrow batch, if the tokenizer drops white space and never looks across it
  (its file says so: the pre-tokenizer keeps what its pattern matches, the pattern excludes white space, and no special token
  holds or eats any), so that a chunk's tokens don't depend on what stands around it; what was found for chunks is kept,
  up to CACHE_BYTES. Where the file says that case doesn't matter and that letters are kept apart from other signs, chunks
  are lower-cased and parted from the signs that end them, so that fewer differ;
* whole texts with any other tokenizer.
Either is cut, where it is longer than SEGMENT_CHARS, at the first place beyond that where tokens must end: `Encoder.cut`
names it for each kind of tokenizer. A string without such a place (a million letters in a row) stays whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, text_array, words_of

DEFAULT = "word_bpe_49k.json"
LIMIT = 2048
BATCH_BYTES = 4 << 20
SEGMENT_CHARS = 1 << 20
#: Bytes of chunks and of what is kept for them, in each worker.
CACHE_BYTES = 64 << 20
#: Words that are encoded as one string where each is one pre-token, and their greatest length.
JOINED, JOINED_CHARS = 1000, 1000

#: Between a letter or digit and a single space that a letter follows, byte-level tokenizers always start a new pre-token.
BEFORE_SPACE = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z])")
#: That space itself: a sentence-piece tokenizer puts it before the second part by itself.
AT_SPACE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")
#: Between a letter and a digit, either way: letters are runs of their own.
AT_DIGIT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
NEVER = re.compile(r"(?!)")
#: A pre-tokenizer of this pattern starts anew between a letter or digit and other signs, and nothing before or after matters.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of ASCII and Latin-1 signs that compose with nothing, and those of them that end in signs after a letter or digit.
PLAIN = "^[\x21-\x7E\u00C0-\u00FF]+$"
LETTERS = "^[a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+$"
ENDING = "^(?P<core>[\x21-\x7E\u00C0-\u00FF]*[A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF])(?P<tail>[!-&(-/:-@\\[-`{-~]+)$"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def drops_space(spec: dict) -> bool:
    """True if tokens of a chunk between white space cannot depend on what stands around the chunk."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    split = next((s for s in steps if s.get("type") == "Split"), None)
    special = spec.get("added_tokens") or []
    return bool(split) and split["behavior"] == "Removed" and split["invert"] and r"[^\s" in split["pattern"].get("Regex", "") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in special) and spec.get("post_processor") is None


def parts_apart(spec: dict) -> bool:
    """True if case doesn't matter, and a chunk's letters and digits are encoded apart from the signs that end it."""
    normal = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    return drops_space(spec) and [n.get("type") for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"} and steps[0]["pattern"] == {"Regex": LETTERS_APART} and [x["type"] for x in steps[1:]] in ([], ["ByteLevel"])


def cut_at(pattern: re.Pattern, text: str, most: int) -> list[str]:
    """The text in parts of about `most` characters, cut only at matches of the pattern, which are left out."""
    parts, at = [], 0
    while len(text) - at > most:
        found = pattern.search(text, at + most)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.end()
    return [*parts, text[at:]]


class Encoder:
    """A tokenizer of one worker process."""

    def __init__(self, name: str):
        path = tokenizer_path(name)
        self.pieces, self.by_word, self.apart = path.endswith(".model"), False, False
        self.known, self.flat, self.ends = pa.array([], pa.large_string()), np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        if self.pieces:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            names = map(self.library.id_to_piece, range(self.library.get_piece_size()))
            alone = not any("\u2581" in p.lstrip("\u2581") for p in names) and self.library.encode("ab cd") == self.library.encode("ab") + self.library.encode("cd")
            self.cut = AT_SPACE if alone else NEVER
            return
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = drops_space(spec)
        special = [a["content"] for a in spec.get("added_tokens") or []]
        self.apart, self.special = parts_apart(spec), [a.lower() for a in special]
        suffix = spec["model"].get("end_of_word_suffix") if self.apart else None
        self.last = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.last[[i for token, i in self.library.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        if self.by_word:  # the pattern keeps letters apart from all else, and no special token holds a digit
            self.cut = AT_DIGIT if r"[\\p{L}]+|[\\p{N}]" in json.dumps(spec["pre_tokenizer"]) and not any(re.search("[0-9]", a) for a in special) else NEVER
        else:
            self.cut = BEFORE_SPACE if not any(" " in a for a in special) else NEVER

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text, by the library; long ones in parts."""
        parts = [cut_at(self.cut, t, SEGMENT_CHARS) if len(t) > SEGMENT_CHARS else [t] for t in texts]
        flat = [p for some in parts for p in some]
        found = self.library.encode(flat, num_threads=1) if self.pieces else [e.ids for e in self.library.encode_batch_fast(flat, add_special_tokens=False)]
        if len(flat) == len(texts):
            return found
        out, at = [], 0
        for some in parts:
            out.append([i for ids in found[at : at + len(some)] for i in ids])
            at += len(some)
        return out

    def parted(self, chunks: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(parts, core, tail): chunk i is encoded as parts[core[i]] and then parts[tail[i]]; many chunks differ only in case and in the signs at their ends. The empty string is the last part. Chunks that hold the text of a special token stay as they are."""
        low = pc.ascii_lower(chunks)
        plain = pc.match_substring_regex(chunks, PLAIN)
        for content in self.special:
            plain = pc.and_not(plain, pc.match_substring(low, content))
        low = pc.if_else(plain, low, chunks)
        found = pc.extract_regex(pc.if_else(plain, low, pa.scalar(None, low.type)), ENDING)
        split = found.is_valid()
        core = pc.if_else(split, pc.struct_field(found, "core"), low)
        tail = pc.if_else(split, pc.struct_field(found, "tail"), pa.scalar("", low.type))
        coded = pc.dictionary_encode(pa.concat_arrays([core, tail, pa.array([""], low.type)]))
        codes = np.asarray(coded.indices).astype(np.int64)
        return coded.dictionary, codes[: len(chunks)], codes[len(chunks) : -1]

    def fresh(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of chunks, by the library."""
        found = self.whole(chunks.to_pylist())
        return np.fromiter((i for ids in found for i in ids), dtype=np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)

    def words_joined(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words that are one pre-token each: with blanks between them they are encoded at once, since a word ends where a token of the ending kind stands."""
        texts = [" ".join(words.slice(lo, JOINED).to_pylist()) for lo in range(0, len(words), JOINED)]
        parts = [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(flat)):
            return self.fresh(words)
        return flat, np.concatenate([[0], ends]).astype(np.int64)

    def of_missing(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of chunks that no earlier batch had."""
        if not self.apart:
            return self.fresh(chunks)
        parts, core, tail = self.parted(chunks)
        easy = np.asarray(pc.and_(pc.match_substring_regex(parts, LETTERS), pc.less_equal(pc.binary_length(parts), JOINED_CHARS)))
        order = np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])
        (ids, ends), (more, stops) = self.words_joined(parts.filter(pa.array(easy))), self.fresh(parts.filter(pa.array(~easy)))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return gathered(np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + stops[1:]]), place[np.stack([core, tail], axis=1).reshape(-1)], 2)

    def of_chunks(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, at): chunk i is entry at[i]; what earlier batches had isn't encoded again."""
        chunks = chunks.cast(pa.large_string())
        at = pc.index_in(chunks, value_set=self.known)
        missing = chunks.filter(at.is_null())
        ids, offsets = self.of_missing(missing)
        known, flat, ends = pa.concat_arrays([self.known, missing]), np.concatenate([self.flat, ids]), np.concatenate([self.ends, self.ends[-1] + offsets[1:]])
        at = np.asarray(pc.fill_null(at, -1)).astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(missing))
        # Arrow's table of the known chunks is built anew for each batch: some 16 bytes of each while it stands.
        if known.nbytes + flat.nbytes + ends.nbytes + 16 * len(known) <= CACHE_BYTES:
            self.known, self.flat, self.ends = known, flat, ends
        else:
            self.known, self.flat, self.ends = known[:0], flat[:0].copy(), np.zeros(1, dtype=np.int64)
        return flat, ends, at

    def encoded(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        if not self.by_word:
            return self.fresh(texts)
        codes, words, offsets = words_of(texts, lower=False)
        flat, ends, at = self.of_chunks(words)
        ids, stops = gathered(flat, ends, at[codes])
        return ids, stops[offsets]

    def counts(self, texts: pa.LargeStringArray) -> np.ndarray:
        """Tokens in each text; ids are dropped at once."""
        if not self.by_word:
            return np.array([len(x) for x in self.whole(texts.to_pylist())], dtype=np.int64)
        codes, words, offsets = words_of(texts, lower=False)
        _, ends, at = self.of_chunks(words)
        return np.diff(np.concatenate([[0], np.cumsum(np.diff(ends)[at][codes])])[offsets])


def gathered(flat: np.ndarray, ends: np.ndarray, at: np.ndarray, each: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of entries `at` one after the other, with an offset for every `each` of them."""
    n = np.diff(ends)[at]
    stops = np.cumsum(n)
    place = np.repeat(ends[at] - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)
    return flat[place], np.concatenate([[0], stops])[::each].astype(np.int64)


ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder; its cache lives as long as the worker."""
    if name not in ENCODERS:
        ENCODERS[name] = Encoder(name)
    return ENCODERS[name]


def count_tokens(docs: DataFrame, tokenizer: str = DEFAULT, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of docs."""
    kind = docs.schema[key].dataType

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, "text", BATCH_BYTES):
                texts = text_array(part.column("text"))
                n = enc.counts(texts)
                yield pa.RecordBatch.from_arrays([part.column("key"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
