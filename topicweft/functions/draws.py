"""Counter-based random numbers: the same key gives the same draw on any
partitioning, after any retry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2**52)
HALF, PRIME = 26, 2**31 - 1
ROUNDS = ((1_103_515_245, 12_345_701), (69_069_069, 362_437_069), (1_664_525_011, 1_013_904_223), (134_775_813, 521_288_629))


def bits(seed: int, *key: Column | int) -> Column:
    """The first 52 bits of an md5 over the key, as a long."""
    parts = [F.lit(str(seed))] + [
        F.lit(str(k)) if isinstance(k, int) else k.cast("string") for k in key
    ]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def uniform(seed: int, *key: Column | int) -> Column:
    """Uniform in [0, 1) from the first 52 bits of an md5 over the key."""
    return bits(seed, *key).cast("double") / TWO_52


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
LONGEST, CHUNK = 55, 32768  # bytes of a message that fits one md5 block


def _md5_start(words: list[np.ndarray | int]) -> np.ndarray:
    """The first 52 bits of the md5 of many one-block messages, given as sixteen 32-bit words each."""
    a, b, c, d = (np.full(len(words[0]), x, np.uint32) for x in _START)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            f, at = d ^ (b & (c ^ d)), i
        elif kind == 1:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif kind == 2:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        if isinstance(words[at], int):
            f += np.uint32((_SINES[i] + words[at]) % 2**32)
        else:
            f += words[at]
            f += np.uint32(_SINES[i])
        turn = _TURNS[kind][i % 4]
        high = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= high
        f += b
        a, b, c, d = d, f, b, c
    first, second = (a + np.uint32(_START[0])).byteswap().astype(np.int64), (b + np.uint32(_START[1])).byteswap().astype(np.int64)
    return (first << 20) | (second >> 12)


def token_bits(seed: int, keys: list[str | None], doc: np.ndarray, pos: np.ndarray, *last: int) -> np.ndarray:
    """``bits(seed, key, pos, *last)`` of many tokens in numpy; token ``i`` is of ``keys[doc[i]]``.

    Tokens whose messages have the same lengths of key and position are hashed together, some ten thousands at a time.
    """
    heads = [(f"{seed}:" if k is None else f"{seed}:{k}:").encode() for k in keys]
    tail = "".join(f":{x}" for x in last).encode()
    out = np.empty(len(doc), np.int64)
    if not len(doc):
        return out
    sizes = np.array([len(h) for h in heads])
    table = np.zeros((len(heads), LONGEST), np.uint8)
    for i, h in enumerate(heads):
        table[i, : min(len(h), LONGEST)] = np.frombuffer(h[:LONGEST], np.uint8)
    digits = np.searchsorted(10 ** np.arange(1, 10), pos, side="right") + 1
    shape = np.minimum(sizes, LONGEST + 1)[doc] * 16 + digits
    order = np.argsort(shape.astype(np.int16), kind="stable")
    ends = np.flatnonzero(np.diff(shape[order])) + 1
    for group in np.split(order, ends):
        head, n = divmod(int(shape[group[0]]), 16)
        size = head + n + len(tail)
        if size > LONGEST:
            for i in group.tolist():
                text = heads[doc[i]] + str(pos[i]).encode() + tail
                out[i] = int(hashlib.md5(text, usedforsecurity=False).hexdigest()[:13], 16)
            continue
        for start in range(0, len(group), CHUNK):
            rows = group[start : start + CHUNK]
            text = np.zeros((len(rows), 64), np.uint8)
            text[:, :head] = table[doc[rows], :head]
            rest = pos[rows].astype(np.int32)
            for j in range(n):
                tens = rest // 10
                text[:, head + n - 1 - j] = rest - 10 * tens + 48
                rest = tens
            text[:, head + n : size] = np.frombuffer(tail, np.uint8)
            text[:, size] = 128
            full = size // 4 + 1
            words = np.ascontiguousarray(text.view("<u4")[:, :full].T)
            out[rows] = _md5_start([*words, *[0] * (14 - full), size * 8, 0])
    return out


def token_uniform(seed: int, keys: list[str | None], doc: np.ndarray, pos: np.ndarray, *last: int) -> np.ndarray:
    """``uniform(seed, key, pos, *last)`` of many tokens in numpy."""
    return token_bits(seed, keys, doc, pos, *last) / TWO_52


def remix(values: np.ndarray, counter: int) -> np.ndarray:
    """Uniform draws in [0, 1), one per 52-bit value and counter (0 to 2**31 - 1).

    Four Feistel rounds on the two halves of a value, so that the draws of one counter are
    a permutation of the values. All products stay below 2**63: ``remixed`` and SQL on 64-bit integers give the same.
    """
    left, right = values >> HALF, values & ((1 << HALF) - 1)
    for number, (by, step) in enumerate(ROUNDS):
        x = (right * by + (counter * step + number)) % PRIME
        left, right = right, left ^ (x * x % PRIME >> 5)
    return ((left << HALF) + right) / TWO_52


def remixed(value: Column, counter: Column | int) -> Column:
    """``remix`` in columns. Each round reads the previous ones by name, so the expression does not double."""
    count = F.lit(counter).cast("long") if isinstance(counter, int) else counter.cast("long")
    state = F.struct(F.shiftright(value, HALF).alias("l"), value.bitwiseAND(F.lit((1 << HALF) - 1)).alias("r"), count.alias("c"))

    def turn(s: Column, step: Column) -> Column:
        x = (s["r"] * step["by"] + (s["c"] * step["step"] + step["number"])) % F.lit(PRIME)
        mixed = F.transform(F.array(x), lambda y: s["l"].bitwiseXOR(F.shiftright(y * y % F.lit(PRIME), 5)))[0]
        return F.struct(s["r"].alias("l"), mixed.alias("r"), s["c"].alias("c"))

    rounds = F.array(*[
        F.struct(F.lit(by).cast("long").alias("by"), F.lit(step).cast("long").alias("step"), F.lit(i).cast("long").alias("number"))
        for i, (by, step) in enumerate(ROUNDS)
    ])
    done = lambda s: (F.shiftleft(s["l"], HALF) + s["r"]).cast("double") / TWO_52
    return F.aggregate(rounds, state, turn, done)
