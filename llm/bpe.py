r"""BPE encoding and decoding with content-defined chunk reuse.

Each text is cut into chunks where a rolling hash of the last bytes hits a fixed residue, so equal
passages give equal chunks wherever they stand. A chunk met before, in any document of the task, is not
encoded again; within a new chunk the same holds for its blank-delimited pieces. Cuts fall anywhere,
also within a word: a chunk keeps its first and last fragments apart, and each join between two chunks
is repaired by encoding the text around it anew, from the blank before it to the blank after it. The
tokenizer drops white space and never merges across it, so there both sides agree exactly; ``Codec``
refuses a tokenizer for which that does not hold.

Reuse is per task, with bounded caches: a table of all chunks would shuffle every text once more.

The vocabulary file is a parameter and is read on each executor.

Defined results: a null or blank text has no tokens and decodes to the empty text; repeated rows are
encoded alike; an empty table gives an empty result; other columns stay where ``encode`` is asked to
keep them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import documents

WINDOW, MEAN_CHUNK = 8, 512
MAX_PIECES, MAX_CHUNKS = 600_000, 20_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks: where the hash of the last WINDOW bytes is 0 modulo MEAN_CHUNK, between characters."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= WINDOW:
        return [len(b)]
    h = np.zeros(len(b) - WINDOW, np.uint32)
    for k in range(WINDOW):
        h = h * np.uint32(0x01000193) + b[k : len(b) - WINDOW + k]
    h ^= h >> np.uint32(15)
    at = np.flatnonzero((h & np.uint32(MEAN_CHUNK - 1)) == 0) + WINDOW
    at = at[(b[at] & 0xC0) != 0x80]
    return [*at.tolist(), len(b)]


# ASCII marks that no contraction or special token holds.
MARKS = ".,;:!?#$%&*+-/=@^_~()[]{}\"`\\"
_MARKS = re.escape(MARKS.encode())
_TRAILING = re.compile(rb"(?<=[a-z0-9])([" + _MARKS + rb"]+)(?=[\x20\x09-\x0D]|\Z)")
_WIDE = re.compile("[^\x00-\u02ff]")


def prepared(text: str) -> bytes:
    """UTF-8 bytes with the same tokens, of which fewer pieces are distinct.

    A-Z in lower case, and marks after a word's last letter or digit as a piece of their own: the
    tokenizer lowers case itself and always splits there. Left as it is where lower case could let a
    combining mark join its letter, or where a special token may stand.
    """
    if "<|" in text or _WIDE.search(text):
        return text.encode("utf-8")
    return _TRAILING.sub(rb" \1", text.encode("utf-8").lower())


class Codec:
    """Encodes and decodes whole texts as the tokenizer does, by reused chunks and pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        if not any(s["type"] == "Split" and s["invert"] and s["behavior"] == "Removed" for s in splits) or spec.get("decoder"):
            raise ValueError("joins can only be repaired at blanks if the tokenizer drops them")
        if {n["type"] for n in spec["normalizer"].get("normalizers", [])} != {"NFC", "Replace", "Lowercase"}:
            raise ValueError("parts of a piece are only its tokens if the tokenizer lowers case")
        if any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must not take blanks")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if any(probe(f"word{m}") != probe(f"word {m}") for m in MARKS) or probe("Word WORD") != probe("word word"):
            raise ValueError("marks behind a word must be pieces of their own, and case must not matter")
        self.vocabulary = np.array([self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())], object)
        suffix = spec["model"]["end_of_word_suffix"]
        self.last = np.array([t.endswith(suffix) for t in self.vocabulary])
        alone = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in "§¶®°|~"}
        mark = next(m for m, ids in alone.items() if len(ids) == 1)
        self.mark, self.mark_id = mark.encode("utf-8"), alone[mark][0]
        self.ids: dict[bytes, bytes] = {}
        self.texts: dict[bytes, str] = {}
        self.chunks: dict[bytes, list] = {}

    def learn(self, pieces: set[bytes]) -> None:
        """Encode the pieces that no text has had so far, many as one text."""
        new = [p for p in pieces if p not in self.ids]
        if len(self.ids) + len(new) > MAX_PIECES:
            self.ids.clear()
            self.texts.clear()
            new = list(pieces)
        # A word of letters is one unit to the tokenizer, whose last token says so; others stand between marks.
        plain, rest = [], []
        for p in new:
            (plain if p.isalpha() or (not p.isascii() and p.decode("utf-8").isalpha()) else rest).append(p)
        for i in range(0, len(plain), 2000):
            if not self.encode(plain[i : i + 2000], b" ", lambda ids: np.flatnonzero(self.last[ids]) + 1, 0):
                rest += plain[i : i + 2000]  # lower case has split a letter
        odd = [p for p in rest if b"<|" in p or self.mark in p]
        rest = [p for p in rest if b"<|" not in p and self.mark not in p] if odd else rest
        for i in range(0, len(rest), 2000):
            self.encode(rest[i : i + 2000], b" " + self.mark + b" ", lambda ids: np.append(np.flatnonzero(ids == self.mark_id), len(ids)), 1)
        for p in odd:
            self.encode([p], b"", lambda ids: np.array([len(ids)]), 0)

    def encode(self, pieces: list[bytes], between: bytes, ends, skip: int) -> bool:
        """Learn pieces from one text; false if it has not as many units as pieces."""
        ids = np.asarray(self.tokenizer.encode(between.join(pieces).decode("utf-8"), add_special_tokens=False).ids, "<u4")
        words, raw, begin, at = self.vocabulary[ids].tolist(), ids.tobytes(), 0, ends(ids).tolist()
        if len(at) != len(pieces):
            return False
        for p, end in zip(pieces, at, strict=True):
            self.ids[p], self.texts[p] = raw[4 * begin : 4 * end], " ".join(words[begin:end])
            begin = end + skip
        return True

    def chunk(self, raw: bytes) -> tuple[bytes, list[bytes], bytes] | None:
        """(first fragment, whole pieces, last fragment); None if no blank is in it."""
        pieces = raw.split()
        head = b"" if _BLANK[raw[0]] else pieces.pop(0)
        if len(head) == len(raw):
            return None
        return head, pieces, b"" if _BLANK[raw[-1]] else pieces.pop()

    def __call__(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each whole text."""
        if len(self.chunks) >= MAX_CHUNKS:
            self.chunks.clear()
        need: set[bytes] = set()
        fresh: dict[bytes, list[bytes]] = {}
        plans = []
        for text in texts:
            raw = prepared(text or "")
            plan, open_, last = [], [], 0  # plan: chunks, and the pieces around their joins
            for end in cuts(raw):
                if end == last:
                    continue
                part, last = raw[last:end], end
                found = self.chunks.get(part)
                if found is None:
                    made = self.chunk(part)
                    if made is None:  # no blank: the join around it reaches further
                        open_.append(part)
                        continue
                    head, pieces, tail = made
                    found = self.chunks[part] = [head, None, None, tail]
                    fresh[part] = pieces
                    need.update(pieces)
                open_.append(found[0])
                if joined := b"".join(open_):
                    need.add(joined)
                    plan.append(joined)
                plan.append(found)
                open_ = [found[3]]
            if joined := b"".join(open_):
                need.add(joined)
                plan.append(joined)
            plans.append(plan)
        self.learn(need)
        ids, shown = self.ids.__getitem__, self.texts.__getitem__
        for part, pieces in fresh.items():
            self.chunks[part][1:3] = b"".join(map(ids, pieces)), " ".join(filter(None, map(shown, pieces)))
        out = []
        for plan in plans:
            got = [(ids(x), shown(x)) if isinstance(x, bytes) else (x[1], x[2]) for x in plan]
            out.append((b"".join([i for i, _ in got]), " ".join([t for _, t in got if t])))
        return out


def encode(docs: DataFrame, vocabulary: str | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int; null unless ``texts``), decoded (null unless ``texts``), ids_sha256, decoded_sha256."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(path)
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                out = []
                for ids, decoded in codec(list(part["text"])):
                    digest = hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()
                    out.append((len(ids) // 4, np.frombuffer(ids, "<i4") if texts else None, decoded if texts else None, *digest))
                made = pd.DataFrame(out, columns=["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])
                yield pd.concat([part[["doc_id"]].reset_index(drop=True), made], axis=1)

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = rows.mapInPandas(run, "doc_id string, n_tokens long, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def op4_bpe(spark, sf_dir):
    return encode(documents(spark, sf_dir), texts=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
