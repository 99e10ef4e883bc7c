"""Text embedders: an interface, a deterministic hashing embedder and an optional ONNX adapter.

The hashing embedder is a stand-in with the right shape (unit vectors); it carries no meaning beyond shared
words.  ``embed_rows`` runs any embedder in Arrow batches on the executors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIM, BATCH, MAX_TOKENS = 384, 256, 128


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One unit vector per text, shape (len(texts), dim)."""


class HashingEmbedder:
    """Signed feature hashing of words and word pairs, L2-normalised."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            words = re.findall(r"[^\W_]+", text.lower())
            for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = zlib.crc32(w.encode())
                row[h % self.dim] += 1.0 if h >> 31 else -1.0
        return l2_normalize(out)


class OnnxEmbedder:
    """A sentence model in ONNX with masked mean pooling; needs onnxruntime, tokenizers and local files."""

    def __init__(self, model: str, tokenizer: str, dim: int = DIM) -> None:
        self.model, self.tokenizer, self.dim, self._session = model, tokenizer, dim, None

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            self._session = onnxruntime.InferenceSession(self.model)
            self._tokens = Tokenizer.from_file(self.tokenizer)
            self._tokens.enable_truncation(MAX_TOKENS)
            self._tokens.enable_padding()
        coded = self._tokens.encode_batch(texts)
        feed = {
            "input_ids": np.array([c.ids for c in coded], dtype=np.int64),
            "attention_mask": np.array([c.attention_mask for c in coded], dtype=np.int64),
            "token_type_ids": np.array([c.type_ids for c in coded], dtype=np.int64),
        }
        wanted = {i.name for i in self._session.get_inputs()}
        states = self._session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
        return l2_normalize(mean_pool(states, feed["attention_mask"]))


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token states that the mask keeps; all-masked rows give zeros."""
    m = mask[:, :, None].astype(states.dtype)
    return (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


def l2_normalize(x: np.ndarray) -> np.ndarray:
    """Unit rows; zero rows stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def vector_to_blob(vector: list[float]) -> bytes:
    return np.asarray(vector, dtype="<f4").tobytes()


def blob_to_vector(blob: bytes) -> list[float]:
    """Little-endian floats; a tail shorter than one float is ignored."""
    return np.frombuffer(blob[: len(blob) // 4 * 4], dtype="<f4").tolist()


def embed_rows(rows: DataFrame, embedder: Embedder, id: str = "symbol_id", text: str = "text") -> DataFrame:
    """(id, vector): texts of a batch are sorted by length to pad little; a failing batch falls back to single texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            order = sorted(range(len(texts)), key=lambda k: len(texts[k] or ""))
            out, kept = [], []
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                try:
                    vectors = embedder.embed([texts[k] or "" for k in part])
                    out += list(vectors)
                    kept += part
                except Exception:
                    for k in part:
                        try:
                            out.append(embedder.embed([texts[k] or ""])[0])
                            kept.append(k)
                        except Exception:  # this text has no vector
                            continue
            vectors = pa.array([v.astype(np.float32).tolist() for v in out], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), vectors], names=[id, "vector"])

    return rows.select(f"`{id}`", f"`{text}`").mapInArrow(run, f"`{id}` long, vector array<float>")
