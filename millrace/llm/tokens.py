"""Token ids of whole texts by the tokenizers library, encoding each distinct chunk between blanks once per worker.

The vocabulary's normaliser and splitter never join characters across a blank or line feed, so the ids
of a text are those of its chunks between blanks in order. `separable` checks this on the vocabulary
file; where it fails, whole texts are encoded directly.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memory import held

#: Distinct chunks a worker keeps; beyond it only those met again stay, at most half as many, so memory stays bounded.
CACHE_CHUNKS = 350_000

def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _specification(path: str) -> tuple[dict, list[dict]]:
    """The vocabulary file and its normalisers."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    return spec, norm["normalizers"] if norm["type"] == "Sequence" else [norm]


def lowers(path: str) -> bool:
    """True if the file's normalisers fold texts to lower case, so that folding them before changes no id."""
    return any(n["type"] == "Lowercase" for n in _specification(path)[1])


def separable(path: str) -> bool:
    """True if the file's normalisers act on single characters or blank runs and its splitter drops blanks."""
    spec, norms = _specification(path)
    blank = [n for n in norms if n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " "]
    plain = all(n["type"] in ("NFC", "NFKC", "NFD", "NFKD", "Lowercase") or n in blank for n in norms)
    pre = spec.get("pre_tokenizer") or {}
    steps = pre["pretokenizers"] if pre.get("type") == "Sequence" else [pre]
    split = steps[0] if steps else {}
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "")
    added = all(" " not in a["content"] and not a["lstrip"] and not a["rstrip"] and not a["single_word"] for a in spec.get("added_tokens", []))
    return bool(plain and drops and added and not spec.get("post_processor"))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk, self.lowers = separable(path), lowers(path)
        signs = [(x, self.tokenizer.encode(x, add_special_tokens=False).ids) for x in "¤§¶|"]
        self.sign, self.sign_id = next(((x, ids[0]) for x, ids in signs if len(ids) == 1), ("", 0))
        self.between = f" {self.sign} " if self.sign else ""
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.uses = np.zeros(1 << 16, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.sizes = np.zeros(1 << 16, dtype=np.int64)

    def _add(self, chunks: list[str]) -> None:
        need = len(self.places) + len(chunks)
        if need > len(self.starts):
            grow = max(need, 2 * len(self.starts))
            self.starts, self.sizes = np.resize(self.starts, grow), np.resize(self.sizes, grow)
            self.uses = np.concatenate((self.uses, np.zeros(grow - len(self.uses), dtype=np.int32)))
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            flat, sizes = self._encode_chunks(part)
            if self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(flat)))
            at = len(self.places)
            self.ids[self.used : self.used + len(flat)] = flat
            self.sizes[at : at + len(part)] = sizes
            self.starts[at : at + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            self.places.update(zip(part, range(at, at + len(part))))

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and how many each has.

        Many short calls cost more than the encoding, so chunks go in by the hundred with a sign between them
        that is a token of its own. Should the signs not come back one for one, chunks go in singly.
        """
        joined = [self.between.join(chunks[i : i + 512]) for i in range(0, len(chunks), 512)] if self.between and not any(self.sign in x for x in chunks) else []
        if joined:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            flat = np.concatenate([np.array([*x, self.sign_id], dtype=np.uint32) for x in lists])
            ends = np.flatnonzero(flat == self.sign_id)
            if len(ends) == len(chunks):
                return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter((x for ids in lists for x in ids), dtype=np.uint32, count=int(sizes.sum())), sizes

    def prune(self) -> None:
        """Keep the chunks met most often, at least twice, and at most half of CACHE_CHUNKS."""
        uses = self.uses[: len(self.places)]
        least = max(2, int(np.partition(uses, -CACHE_CHUNKS // 2)[-CACHE_CHUNKS // 2]) + 1) if len(uses) > CACHE_CHUNKS // 2 else 2
        kept = np.flatnonzero(uses >= least)
        sizes, starts = self.sizes[kept], self.starts[kept]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
        names = list(self.places)
        places = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.clear()
        self.places, self.ids, self.used = places, ids if total else self.ids, total
        self.sizes, self.starts, self.uses = (np.resize(x, max(len(x), 1 << 16)) for x in (sizes, ends - sizes, np.ones(max(len(kept), 1), dtype=np.int32)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array in order, and where each text's begin (their number at last). Nulls are empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        if not self.by_chunk:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
            return np.fromiter((x for ids in lists for x in ids), dtype=np.uint32, count=int(bounds[-1])), bounds
        # Two changes that leave the ids alone and make chunks recur: a blank between an ASCII letter and a
        # following point or comma, where the splitter cuts anyway, and lower case where the vocabulary folds it and no special token can arise.
        texts = pc.replace_substring_regex(texts, pattern="([A-Za-z])([.,])", replacement=r"\1 \2")
        if self.lowers and not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), pattern=" ")  # empty chunks have no ids
        flat = lists.flatten().dictionary_encode()
        texts_at = lists.offsets.to_numpy().astype(np.int64)
        texts_at = texts_at - texts_at[0]
        names = flat.dictionary.to_pylist()
        if len(self.places) + len(names) > CACHE_CHUNKS:
            self.prune()
        new = [x for x in names if x not in self.places]
        self._add([x for x in new if self.sign not in x] if self.sign else new)
        if self.sign:
            self._add([x for x in new if self.sign in x])
        place = np.fromiter(map(self.places.__getitem__, names), dtype=np.int64, count=len(names))
        if len(names):
            self.uses[place] += np.bincount(flat.indices.to_numpy(zero_copy_only=False), minlength=len(names)).astype(np.int32)
            place = place[flat.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[place] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.concatenate(([0], ends))[texts_at]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return held(path, lambda: Encoder(path))
