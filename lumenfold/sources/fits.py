"""Binary tables of FITS files as observations: the files are read by Spark, parsed in tasks."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import observations

BLOCK = 2880
#: The format's column codes and their big-endian types.
CODES = {"L": "i1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


def _header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Cards of the header at an offset, and where its data start."""
    cards: dict[str, str] = {}
    while at < len(data):
        for k in range(at, at + BLOCK, 80):
            card = data[k : k + 80].decode("ascii", "replace")
            if card.startswith("END"):
                return cards, at + BLOCK
            if card[8:10] == "= ":
                value = card[10:]
                m = re.match(r"\s*'((?:[^']|'')*)'", value)
                cards[card[:8].strip()] = m[1].rstrip() if m else value.split("/")[0].strip()
        at += BLOCK
    raise ValueError("a header without end")


def tables(data: bytes) -> list[dict[str, np.ndarray]]:
    """Scalar numeric columns of each binary table, scaled."""
    found, at = [], 0
    while at < len(data):
        cards, start = _header(data, at)
        axes = [int(cards.get(f"NAXIS{i + 1}", 0)) for i in range(int(cards.get("NAXIS", 0)))]
        size = abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0
        size += int(cards.get("PCOUNT", 0)) if axes else 0
        if cards.get("XTENSION", "").startswith("BINTABLE"):
            fields, kinds = [], {}
            for i in range(1, int(cards["TFIELDS"]) + 1):
                repeat, code = re.match(r"(\d*)([A-Z])", cards[f"TFORM{i}"]).groups()
                n, name = int(repeat or 1), cards.get(f"TTYPE{i}", f"col{i}")
                width = {"P": 8, "Q": 16, "X": -(-n // 8), "C": 8 * n, "M": 16 * n}.get(code)
                if width is not None or code not in CODES:
                    fields.append((name, f"V{width if width is not None else n}"))
                elif code == "A":
                    fields.append((name, f"S{max(n, 1)}"))
                else:
                    fields.append((name, CODES[code], (n,)) if n != 1 else (name, CODES[code]))
                    if n == 1:
                        kinds[name] = (float(cards.get(f"TSCAL{i}", 1)), float(cards.get(f"TZERO{i}", 0)))
            rows = np.frombuffer(data, np.dtype(fields), axes[1], start)
            found.append({n: rows[n].astype(float) * s + z for n, (s, z) in kinds.items()})
        at = start + -(-size // BLOCK) * BLOCK
    return found


def read_fits(spark: SparkSession, path: str, table: int = 0, domain: str | None = None, **roles: str) -> DataFrame:
    """Observations of the ``table``-th binary table of each file; the object is the file's stem."""

    def parse(frames):
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                t = tables(bytes(content))[table]
                names = observations.resolve_roles(list(t), domain, **roles)
                nan = np.full(len(t[names["t"]]), np.nan)
                yield pd.DataFrame({"object_id": re.sub(r"\.[^./]*$", "", file.rsplit("/", 1)[1]), "t": t[names["t"]], "y": t[names["y"]], "dy": t[names["dy"]] if "dy" in names else nan, "rid": np.arange(len(nan))})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    out = raw.mapInPandas(parse, "object_id string, t double, y double, dy double, rid long")
    return out.select("object_id", F.lit(None).cast("string").alias("band"), "t", "y", F.when(~F.isnan("dy"), F.col("dy")).alias("dy"), "rid")
