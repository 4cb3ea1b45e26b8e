"""Image files: the built-in image source, a PNG writer, label files, IDX files and archives, made-up glyphs."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PACKED = "image_id string, h int, w int, channels int, data binary"
ITEMS = "sample_id long, item binary"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, h, w, channels, data) in RGB order; the source holds BGR. A missing path is an error."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def run(batches):
        for pdf in batches:
            pdf["data"] = [np.frombuffer(d, np.uint8).reshape(-1, c)[:, ::-1].tobytes() if c >= 3 else d for d, c in zip(pdf["data"], pdf["nChannels"], strict=True)]
            yield pdf.rename(columns={"origin": "image_id", "height": "h", "width": "w", "nChannels": "channels"})[["image_id", "h", "w", "channels", "data"]]

    return raw.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, PACKED)


def as_gray(df: DataFrame) -> DataFrame:
    """Luma in integers, (299 R + 587 G + 114 B) / 1000 rounded half up in sixteenths of 65536."""

    def run(batches):
        for pdf in batches:
            out = []
            for d, c in zip(pdf["data"], pdf["channels"], strict=True):
                a = np.frombuffer(d, np.uint8).reshape(-1, c).astype(np.int64)
                out.append(((a[:, 0] * 19595 + a[:, 1] * 38470 + a[:, 2] * 7471 + 0x8000) >> 16).astype(np.uint8).tobytes() if c >= 3 else d)
            yield pdf.assign(data=out, channels=1)

    return df.mapInPandas(run, PACKED)


def png(a: np.ndarray) -> bytes:
    """8-bit gray, RGB or RGBA; other types are clipped to 0..255 and cut to whole levels."""
    if a.dtype != np.uint8:
        a = np.clip(a, 0, 255).astype(np.uint8)
    kind = {1: 0, 3: 2, 4: 6}.get(1 if a.ndim == 2 else a.shape[-1] if a.ndim == 3 else 0)
    if kind is None or a.ndim == 3 and a.shape[-1] == 1:
        raise ValueError("an image is gray, RGB or RGBA")
    h, w = a.shape[:2]

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    lines = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_images(df: DataFrame, folder: str) -> DataFrame:
    """Writes <image_id>.png files under a folder that Arrow's file systems reach; (image_id, path)."""

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            rows = []
            for i, h, w, c, d in zip(pdf["image_id"], pdf["h"], pdf["w"], pdf["channels"], pdf["data"], strict=True):
                a = np.frombuffer(d, np.uint8).reshape((h, w) if c == 1 else (h, w, c))
                with store.open_output_stream(f"{root}/{i}.png") as out:
                    out.write(png(a))
                rows.append((i, f"{folder}/{i}.png"))
            yield pd.DataFrame(rows, columns=["image_id", "path"])

    return df.selectExpr("cast(image_id as string) image_id", "h", "w", "channels", "data").mapInPandas(run, "image_id string, path string")


def side_by_side(images: list[np.ndarray], gap: int = 4, level: int = 255) -> np.ndarray:
    if not images:
        raise ValueError("no images")
    rgb = [np.repeat(a[..., None], 3, axis=2) if a.ndim == 2 else a[..., :3] for a in images]
    h = max(a.shape[0] for a in rgb)
    parts = []
    for a in rgb:
        parts += [np.full((h, gap, 3), level, np.uint8)] if parts else []
        parts.append(np.pad(a, ((0, h - a.shape[0]), (0, 0), (0, 0))))
    return np.concatenate(parts, axis=1)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(filename, expected) of a JSON object; an entry without letters or digits is an error."""
    from tessella.functions.text import normalize_label

    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("filename", "label"))
    return pairs.select("filename", normalize_label(F.col("label")).alias("expected"))


def _idx_header(stream) -> tuple[int, tuple[int, ...]]:
    """How many items follow, and the shape of each: images (magic 2051) or labels (2049), big-endian."""
    magic, n = struct.unpack(">II", stream.read(8))
    if magic not in (2049, 2051):
        raise ValueError("neither images nor labels")
    return n, struct.unpack(">II", stream.read(8)) if magic == 2051 else ()


def idx_blocks(stream, rows: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first, items) of a stream, at most `rows` at a time; the count must agree."""
    n, shape = _idx_header(stream)
    size = int(np.prod(shape))
    for first in range(0, n, rows):
        part = stream.read(size * min(rows, n - first))
        if len(part) != size * min(rows, n - first):
            raise ValueError("the file does not hold as many items as it says")
        yield first, np.frombuffer(part, np.uint8).reshape(-1, *shape)
    if stream.read(1):
        raise ValueError("the file does not hold as many items as it says")


def parse_idx(data: bytes) -> np.ndarray:
    n, shape = _idx_header(io.BytesIO(data))
    blocks = [a for _, a in idx_blocks(io.BytesIO(data), max(1, n))]
    return blocks[0] if blocks else np.empty((0, *shape), np.uint8)


def parse_mapping(text: str) -> dict[int, str]:
    return {int(i): chr(int(c)) for i, c in (line.split()[:2] for line in text.splitlines() if line.strip())}


def _item_frames(stream):
    import pandas as pd

    for first, a in idx_blocks(stream):
        yield pd.DataFrame({"sample_id": range(first, first + len(a)), "item": [x.tobytes() for x in a]})


def emnist_rows(spark: SparkSession, images: str, labels: str, mapping: str, chars: str, per_class: int | None = 300, seed: int = 42) -> DataFrame:
    """`wanted_glyphs` of three unpacked files."""

    def items(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield from _item_frames(io.BytesIO(content))

    def load(path):
        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(items, ITEMS)

    return wanted_glyphs(load(images), load(labels), spark.read.text(mapping), chars, per_class, seed)


def archive_members(split: str = "byclass", train: bool = True) -> dict[str, str]:
    """Names of the members of a zipped archive that hold one part of a split."""
    start = f"gzip/emnist-{split}"
    part = f"{start}-{'train' if train else 'test'}"
    return {"images": f"{part}-images-idx3-ubyte.gz", "labels": f"{part}-labels-idx1-ubyte.gz", "mapping": f"{start}-mapping.txt"}


def emnist_archive(spark: SparkSession, archive: str, chars: str = CHARS, split: str = "byclass", train: bool = True, per_class: int | None = 300, seed: int = 42) -> DataFrame:
    """`wanted_glyphs` of one part of a zipped archive, at a path that Arrow's file systems reach.

    A packed member can be read from its start alone, so one task streams it, in blocks; a
    missing archive or member is an error."""
    members = archive_members(split, train)

    def opened(batches, member):
        from pyarrow import fs

        for pdf in batches:
            for uri in pdf["archive"]:
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as whole, zipfile.ZipFile(whole) as names, names.open(member) as packed:
                    yield packed

    def items(member):
        def run(batches):
            for packed in opened(batches, member):
                with gzip.open(packed) as stream:
                    yield from _item_frames(stream)

        return run

    def lines(batches):
        import pandas as pd

        for packed in opened(batches, members["mapping"]):
            yield pd.DataFrame({"value": packed.read().decode("utf-8").splitlines()})

    one = spark.createDataFrame([(archive,)], "archive string")
    load = {kind: one.mapInPandas(items(members[kind]), ITEMS) for kind in ("images", "labels")}
    return wanted_glyphs(load["images"], load["labels"], one.mapInPandas(lines, "value string"), chars, per_class, seed)


def wanted_glyphs(items: DataFrame, labels: DataFrame, mapping: DataFrame, chars: str, per_class: int | None, seed: int) -> DataFrame:
    """(sample_id, label, h, w, data): wanted characters, at most `per_class` of each by hash order,
    transposed and fitted to 32 x 32, in a seeded order."""
    from pyspark.sql import Window

    from tessella.operators import kernels

    names = mapping.where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p")).select(F.col("p")[0].cast("int").alias("k"), F.expr("chr(cast(p[1] as int))").alias("label"))
    names = names.where(F.col("label").isin(list(chars)))
    of = labels.select("sample_id", F.conv(F.hex("item"), 16, 10).cast("int").alias("k")).join(names, "k")
    if per_class is not None:
        order = Window.partitionBy("label").orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id")
        of = of.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_class)
    both = items.join(of.select("sample_id", "label"), "sample_id")

    def fit(batches):
        for pdf in batches:
            side = [int(len(d) ** 0.5) for d in pdf["item"]]
            pdf["data"] = [kernels.fit_glyph(np.frombuffer(d, np.uint8).reshape(n, n).T).tobytes() for d, n in zip(pdf["item"], side, strict=True)]
            yield pdf.assign(h=32, w=32)[["sample_id", "label", "h", "w", "data"]]

    return both.mapInPandas(fit, "sample_id long, label string, h int, w int, data binary").orderBy(F.xxhash64("sample_id", F.lit(seed + 1)))


# The bars of a fourteen-bar display that show each character, and the ends of each
# bar on a lattice of three by three points (column, row).
BARS = {
    "0": "abcdefkl", "1": "bck", "2": "abdegh", "3": "abcdh", "4": "bcfgh", "5": "adfgn", "6": "acdefgh", "7": "abc", "8": "abcdefgh",
    "9": "abcdfgh", "A": "abcefgh", "B": "abcdhjm", "C": "adef", "D": "abcdjm", "E": "adefgh", "F": "aefg", "G": "acdefh", "H": "bcefgh",
    "I": "adjm", "J": "bcde", "K": "efgkn", "L": "def", "M": "bcefik", "N": "bcefin", "O": "abcdef", "P": "abefgh", "Q": "abcdefn",
    "R": "abefghn", "S": "acdfgh", "T": "ajm", "U": "bcdef", "V": "efkl", "W": "bcefln", "X": "ikln", "Y": "ikm", "Z": "adkl",
}
ENDS = {
    "a": (0, 0, 2, 0), "b": (2, 0, 2, 1), "c": (2, 1, 2, 2), "d": (0, 2, 2, 2), "e": (0, 1, 0, 2), "f": (0, 0, 0, 1), "g": (0, 1, 1, 1),
    "h": (1, 1, 2, 1), "i": (0, 0, 1, 1), "j": (1, 0, 1, 1), "k": (2, 0, 1, 1), "l": (1, 1, 0, 2), "m": (1, 1, 1, 2), "n": (1, 1, 2, 2),
}


@cache
def bar_font(ch: str) -> np.ndarray:
    """A character as 29 x 21 levels: all cells within two of one of its bars."""
    y, x = np.mgrid[:29, :21]
    near = np.zeros(y.shape, bool)
    for bar in BARS[ch]:
        x0, y0, x1, y1 = np.array(ENDS[bar]) * (8, 12, 8, 12) + 2
        along = np.clip(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2), 0, 1)
        near |= np.hypot(x - x0 - along * (x1 - x0), y - y0 - along * (y1 - y0)) <= 2
    return near * np.uint8(255)


# Fixed values of the augmentation: ranges of size, width, height, turn, slant, blur and level,
# the spread of the centre, choices of stroke and of growing or thinning, shares of specks.
CANVAS = 80
SIZE, WIDTH, HEIGHT = (42, 62), (0.72, 1.28), (0.82, 1.16)
TURN, SLANT, CENTRE = 10.0, 0.16, 2.8
STROKES = (0, 0, 0, 1, 1, 2)
SOFTENED, SOFTNESS = 0.45, (0.15, 1.0)
LEVELS = (70, 150)
CHANGES = ("none", "none", "none", "dilate", "dilate", "erode")
SPECKLED, SPECKS = 0.45, 0.0015


def augmented(pattern: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One 32 x 32 glyph from a character's pattern.

    Size, place, proportions, turn and slant are one affine map, so that the pattern is
    sampled once; stroke, blur, level, thickness and specks follow."""
    from tessella.operators import kernels

    high = int(rng.integers(*SIZE))
    wide = max(1, round(high * 0.7))
    place, turn, slant = rng.normal(0, CENTRE, 2), np.deg2rad(rng.uniform(-TURN, TURN)), rng.uniform(-SLANT, SLANT)
    scale = np.diag([rng.uniform(*WIDTH), rng.uniform(*HEIGHT)])
    turned = np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
    back = np.linalg.inv(np.array([[1.0, slant], [0.0, 1.0]]) @ turned @ scale)
    big = np.pad(kernels.resize(pattern, (high, wide), 0), 2 * max(STROKES))
    stroke = 2 * int(rng.choice(STROKES)) + 1
    big = kernels.dilate(big, stroke, stroke)
    y, x = np.mgrid[:CANVAS, :CANVAS] - (CANVAS - 1) / 2
    xs = back[0, 0] * x + back[0, 1] * y - place[0] + (big.shape[1] - 1) / 2
    ys = back[1, 0] * x + back[1, 1] * y - place[1] + (big.shape[0] - 1) / 2
    a = kernels.bilinear(big, xs, ys, 0)
    if rng.random() < SOFTENED:
        a = kernels.blur(a, 5, float(rng.uniform(*SOFTNESS)))
    a = kernels.threshold(a, int(rng.integers(*LEVELS)))
    change = rng.choice(CHANGES)
    if change != "none":
        a = (kernels.dilate if change == "dilate" else kernels.erode)(a, 2, 2)
    if rng.random() < SPECKLED:
        speck = rng.random(a.shape)
        a = np.where(speck < SPECKS, 255, np.where(speck > 1 - SPECKS, 0, a)).astype(np.uint8)
    return kernels.fit_glyph(a)


def synthetic_glyphs(spark: SparkSession, chars: str = CHARS, per_class: int = 600, seed: int = 42, font: Callable[[str], np.ndarray] = bar_font) -> DataFrame:
    """(sample_id, label, h, w, data): augmented 32 x 32 glyphs, the same at every run."""
    n = len(chars) * per_class
    ids = spark.range(n).withColumn("label", F.element_at(F.array(*[F.lit(c) for c in chars]), (F.col("id") % len(chars) + 1).cast("int")))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(i, ch, 32, 32, augmented(font(ch), np.random.default_rng([seed, int(i)])).tobytes()) for i, ch in zip(pdf["id"], pdf["label"], strict=True)]
            yield pd.DataFrame(out, columns=["sample_id", "label", "h", "w", "data"])

    return ids.mapInPandas(run, "sample_id long, label string, h int, w int, data binary").orderBy(F.xxhash64("sample_id", F.lit(seed)))
