"""A bidirectional transformer encoder for embeddings, in numpy, and a reader of its weight files.

Weights are tensors in files of one format: eight bytes with the length of a JSON header (little-endian), the header
(name -> dtype, shape, data_offsets), the data.  Files are mapped, not read: a worker loads only what it multiplies by.

The encoder: token embeddings times the square root of the hidden size; layers of attention and a gated feed-forward part,
each between two RMS norms and added to its input; a last norm.  Attention has grouped keys and values, norms
of queries and keys, rotary positions (one base for layers that see everything, one for those that see a window),
and no causal mask.  A text's vector is the mean over its tokens through two projections, cut and scaled to length 1.
"""

from __future__ import annotations

import json
import math
import os
import re
import tempfile
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

FULL, SLIDING = "full_attention", "sliding_attention"


class Tensors:
    """float32 tensors of one or more mapped files by name."""

    def __init__(self, paths: Sequence[str]):
        self.places: dict[str, tuple[np.memmap, dict]] = {}
        for path in paths:
            data = np.memmap(path, np.uint8, "r")
            size = int.from_bytes(data[:8].tobytes(), "little")
            if 8 + size > len(data):
                raise ValueError(f"{path} has no whole header")
            for name, entry in json.loads(data[8 : 8 + size].tobytes()).items():
                if name == "__metadata__":
                    continue
                if name in self.places:
                    raise ValueError(f"tensor {name} is in two files")
                self.places[name] = data[8 + size :], entry

    def get(self, name: str, *shape: int) -> np.ndarray:
        if name not in self.places:
            raise KeyError(f"there is no tensor {name}")
        data, entry = self.places[name]
        if entry["dtype"] != "F32":
            raise ValueError(f"tensor {name} is {entry['dtype']}, not F32")
        if tuple(entry["shape"]) != shape:
            raise ValueError(f"tensor {name} has the shape {entry['shape']}, not {list(shape)}")
        low, high = entry["data_offsets"]
        if high - low != 4 * math.prod(shape) or high > len(data):
            raise ValueError(f"tensor {name} is cut off")
        return np.frombuffer(data[low:high], "<f4").reshape(shape)


def write_tensors(path: str, tensors: dict[str, np.ndarray]) -> None:
    """The file that ``Tensors`` reads."""
    head, at = {}, 0
    for name, x in tensors.items():
        head[name] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [at, at + 4 * x.size]}
        at += 4 * x.size
    raw = json.dumps(head).encode()
    raw += b" " * (-len(raw) % 8)
    with open(path, "wb") as f:
        f.write(len(raw).to_bytes(8, "little") + raw)
        for x in tensors.values():
            f.write(np.ascontiguousarray(x, "<f4").tobytes())


@dataclass(frozen=True)
class Config:
    hidden_size: int
    intermediate_size: int
    layer_types: tuple[str, ...]
    num_attention_heads: int
    num_key_value_heads: int
    head_dim: int
    query_pre_attn_scalar: int
    sliding_window: int
    vocab_size: int
    pad_token_id: int = 0
    rms_norm_eps: float = 1e-6
    rope_local_base_freq: float = 10_000.0
    rope_theta: float = 1_000_000.0
    projection_size: int = 3072

    def __post_init__(self):
        if self.num_attention_heads % self.num_key_value_heads:
            raise ValueError("heads must be a multiple of key/value heads")
        if self.num_attention_heads * self.head_dim != self.hidden_size:
            raise ValueError("heads do not make up the hidden size")
        if self.sliding_window < 2:
            raise ValueError("the window is too small")
        if not set(self.layer_types) <= {FULL, SLIDING}:
            raise ValueError("an unknown type of layer")

    @property
    def reach(self) -> int:
        """A windowed query sees keys nearer than this, on both sides."""
        return self.sliding_window // 2 + 1


def rms_norm(x: np.ndarray, weight: np.ndarray, epsilon: float) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + epsilon) * (1 + weight)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


def rotated(x: np.ndarray, base: float) -> np.ndarray:
    """[..., positions, head_dim]: the halves of each vector turned against each other by its position."""
    half = x.shape[-1] // 2
    turn = np.outer(np.arange(x.shape[-2]), base ** (-np.arange(half) / half)).astype(x.dtype)
    a, b = x[..., :half], x[..., half:]
    return np.concatenate((a * np.cos(turn) - b * np.sin(turn), b * np.cos(turn) + a * np.sin(turn)), -1)


class Encoder:
    """Vectors of token ids; ``tensors`` hold the encoder, ``first`` and ``second`` the projections."""

    def __init__(self, config: Config, tensors: Tensors, first: Tensors, second: Tensors):
        c, self.config = config, config
        wide, narrow = c.num_attention_heads * c.head_dim, c.num_key_value_heads * c.head_dim
        shapes = {"self_attn.q_proj": (wide, c.hidden_size), "self_attn.k_proj": (narrow, c.hidden_size), "self_attn.v_proj": (narrow, c.hidden_size), "self_attn.o_proj": (c.hidden_size, wide), "self_attn.q_norm": (c.head_dim,), "self_attn.k_norm": (c.head_dim,)}
        shapes |= {"mlp.gate_proj": (c.intermediate_size, c.hidden_size), "mlp.up_proj": (c.intermediate_size, c.hidden_size), "mlp.down_proj": (c.hidden_size, c.intermediate_size)}
        shapes |= {f"{n}_layernorm": (c.hidden_size,) for n in ("input", "post_attention", "pre_feedforward", "post_feedforward")}
        self.layers = [{n: tensors.get(f"layers.{i}.{n}.weight", *s) for n, s in shapes.items()} for i in range(len(c.layer_types))]
        self.tokens, self.norm = tensors.get("embed_tokens.weight", c.vocab_size, c.hidden_size), tensors.get("norm.weight", c.hidden_size)
        self.first, self.second = first.get("linear.weight", c.projection_size, c.hidden_size), second.get("linear.weight", c.hidden_size, c.projection_size)

    def attention(self, x: np.ndarray, w: dict, kind: str, mask: np.ndarray) -> np.ndarray:
        """``mask`` [batch, tokens]: which tokens are real."""
        c, (n, t, _) = self.config, x.shape
        heads = lambda y, k: y.reshape(n, t, k, c.head_dim).transpose(0, 2, 1, 3)
        base = c.rope_theta if kind == FULL else c.rope_local_base_freq
        q = rotated(rms_norm(heads(x @ w["self_attn.q_proj"].T, c.num_attention_heads), w["self_attn.q_norm"], c.rms_norm_eps), base)
        k = rotated(rms_norm(heads(x @ w["self_attn.k_proj"].T, c.num_key_value_heads), w["self_attn.k_norm"], c.rms_norm_eps), base)
        v = heads(x @ w["self_attn.v_proj"].T, c.num_key_value_heads)
        groups = c.num_attention_heads // c.num_key_value_heads
        scores = q @ np.repeat(k, groups, 1).transpose(0, 1, 3, 2) / math.sqrt(c.query_pre_attn_scalar)
        seen = mask[:, None, None, :]
        if kind == SLIDING:
            at = np.arange(t)
            seen = seen & (np.abs(at[:, None] - at) < c.reach)
        scores = np.where(seen, scores, -np.inf)
        most = scores.max(-1, keepdims=True)
        p = np.exp(scores - np.where(np.isfinite(most), most, 0))
        p /= np.maximum(p.sum(-1, keepdims=True), 1e-30)  # (padding that sees no token)
        return (p @ np.repeat(v, groups, 1)).transpose(0, 2, 1, 3).reshape(n, t, -1) @ w["self_attn.o_proj"].T

    def states(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        c = self.config
        if ids.max(initial=0) >= c.vocab_size:
            raise ValueError("an id out of the vocabulary")
        x = self.tokens[ids] * np.float32(math.sqrt(c.hidden_size))
        for w, kind in zip(self.layers, c.layer_types, strict=True):
            norm = lambda y, name, w=w: rms_norm(y, w[f"{name}_layernorm"], c.rms_norm_eps)
            x = x + norm(self.attention(norm(x, "input"), w, kind, mask), "post_attention")
            y = norm(x, "pre_feedforward")
            x = x + norm((gelu(y @ w["mlp.gate_proj"].T) * (y @ w["mlp.up_proj"].T)) @ w["mlp.down_proj"].T, "post_feedforward")
        return rms_norm(x, self.norm, c.rms_norm_eps)

    def vectors(self, batch: Sequence[Sequence[int]], dims: int | None = None) -> np.ndarray:
        """Unit vectors [n, dims] of lists of ids, none empty."""
        if not batch or not all(map(len, batch)):
            raise ValueError("every input needs a token")
        size = np.array([len(x) for x in batch])
        mask = np.arange(size.max()) < size[:, None]
        ids = np.full(mask.shape, self.config.pad_token_id, np.int64)
        ids[mask] = np.concatenate([np.asarray(x) for x in batch])
        mean = (self.states(ids, mask) * mask[:, :, None]).sum(1) / size[:, None]
        out = (mean @ self.first.T @ self.second.T)[:, : dims or self.config.hidden_size]
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def model(make: Callable[[], tuple[Encoder, Callable[[list[str]], list[list[int]]]]]) -> Callable[[list[str]], np.ndarray]:
    """A model for ``embed.embed``; ``make`` gives the encoder and a tokenizer and runs once in each worker."""
    held: list = []

    def run(texts: list[str]) -> np.ndarray:
        if not held:
            held.append(make())
        encoder, tokenize = held[0]
        return encoder.vectors(tokenize(texts))

    return run


def drawn(config: Config, seed: int = 0) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Random weights of an encoder and its two projections."""
    rng, c = np.random.default_rng(seed), config
    draw = lambda *s: rng.normal(0, s[-1] ** -0.5, s).astype(np.float32)
    wide, narrow = c.num_attention_heads * c.head_dim, c.num_key_value_heads * c.head_dim
    out = {"embed_tokens.weight": draw(c.vocab_size, c.hidden_size), "norm.weight": draw(c.hidden_size)}
    for i in range(len(c.layer_types)):
        at = f"layers.{i}"
        out |= {f"{at}.self_attn.{n}_proj.weight": draw(m, c.hidden_size) for n, m in (("q", wide), ("k", narrow), ("v", narrow))}
        out |= {f"{at}.self_attn.o_proj.weight": draw(c.hidden_size, wide), f"{at}.self_attn.q_norm.weight": draw(c.head_dim), f"{at}.self_attn.k_norm.weight": draw(c.head_dim)}
        out |= {f"{at}.mlp.{n}_proj.weight": draw(c.intermediate_size, c.hidden_size) for n in ("gate", "up")} | {f"{at}.mlp.down_proj.weight": draw(c.hidden_size, c.intermediate_size)}
        out |= {f"{at}.{n}_layernorm.weight": draw(c.hidden_size) for n in ("input", "post_attention", "pre_feedforward", "post_feedforward")}
    return out, {"linear.weight": draw(c.projection_size, c.hidden_size)}, {"linear.weight": draw(c.hidden_size, c.projection_size)}


SMALL = Config(32, 48, (SLIDING, FULL), 4, 2, 8, 8, 16, 1000, projection_size=64)


def small() -> tuple[Encoder, Callable[[list[str]], list[list[int]]]]:
    """A small encoder of drawn weights, read from mapped files, with a tokenizer that hashes words."""
    with tempfile.TemporaryDirectory() as folder:  # this worker's own copy: the files stay mapped
        paths = [os.path.join(folder, f"{n}.tensors") for n in range(3)]
        for path, weights in zip(paths, drawn(SMALL), strict=True):
            write_tensors(path, weights)
        made = Encoder(SMALL, *(Tensors([p]) for p in paths))
    return made, lambda texts: [[1, *(2 + zlib.crc32(w.encode()) % (SMALL.vocab_size - 2) for w in re.findall(r"\w+", t))] for t in texts]
