import gzip
import io
import struct
import zipfile

import numpy as np
import pytest

from tessella.operators import kernels
from tessella.operators.models import load_mlp
from tessella.plans import recognition
from tessella.sources import images


def archive(path, n=8, split="byclass", part="train", labels=None, pixels=None):
    pix = np.zeros((n, 28, 28), np.uint8) if pixels is None else pixels
    if pixels is None:
        pix[::2, 5:20, 8:12] = 255
        pix[1::2, 8:12, 6:22] = 255
    kinds = bytes(i % 2 for i in range(n)) if labels is None else labels
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(f"gzip/emnist-{split}-mapping.txt", "0 48\n1 65\n\n")
        z.writestr(f"gzip/emnist-{split}-{part}-images-idx3-ubyte.gz", gzip.compress(struct.pack(">IIII", 2051, n, 28, 28) + pix.tobytes()))
        z.writestr(f"gzip/emnist-{split}-{part}-labels-idx1-ubyte.gz", gzip.compress(struct.pack(">II", 2049, n) + kinds))
    return pix


def test_zipped_archive(spark, tmp_path):
    pix = archive(tmp_path / "a.zip")
    got = images.emnist_archive(spark, str(tmp_path / "a.zip"), "0A", per_class=None).collect()
    assert sorted(r.label for r in got) == ["0"] * 4 + ["A"] * 4
    for r in got:
        assert bytes(r.data) == kernels.fit_glyph(pix[r.sample_id].T).tobytes()
    few = images.emnist_archive(spark, f"file://{tmp_path}/a.zip", "A", per_class=3).collect()
    assert [r.label for r in few] == ["A"] * 3 and len({r.sample_id for r in few}) == 3


def test_splits_and_missing_members(spark, tmp_path):
    archive(tmp_path / "t.zip", 4, "letters", "test")
    assert images.emnist_archive(spark, str(tmp_path / "t.zip"), "0A", "letters", False).count() == 4
    assert images.archive_members("letters", False)["labels"] == "gzip/emnist-letters-test-labels-idx1-ubyte.gz"
    for path, split in ((tmp_path / "t.zip", "byclass"), (tmp_path / "none.zip", "letters")):
        with pytest.raises(Exception):
            images.emnist_archive(spark, str(path), "0A", split, False).count()
    archive(tmp_path / "e.zip", 0)
    assert images.emnist_archive(spark, str(tmp_path / "e.zip")).count() == 0


@pytest.mark.parametrize("rows", [1, 3, 7, 100])
def test_blocks_of_items(rows):
    a = np.random.default_rng(1).integers(0, 256, (7, 2, 3), np.uint8)
    data = struct.pack(">IIII", 2051, 7, 2, 3) + a.tobytes()
    blocks = list(images.idx_blocks(io.BytesIO(data), rows))
    assert [first for first, _ in blocks] == list(range(0, 7, rows)) and (np.concatenate([b for _, b in blocks]) == a).all()
    assert (images.parse_idx(data) == a).all()
    for bad in (data[:-1], data + b"\0", b"\0\0\0\7" + data[4:]):
        with pytest.raises(ValueError):
            list(images.idx_blocks(io.BytesIO(bad), rows))
        with pytest.raises(ValueError):
            images.parse_idx(bad)
    assert images.parse_idx(struct.pack(">IIII", 2051, 0, 28, 28)).shape == (0, 28, 28)


def test_network_of_an_archive(spark, tmp_path):
    archive(tmp_path / "a.zip", 20)
    report = recognition.train_handwritten(spark, str(tmp_path / "a.zip"), f"file://{tmp_path}/m", "0A", epochs=30, batch=4, hidden=(8,))
    assert report["n_classes"] == 2 and report["last_loss"] < report["first_loss"] and report["holdout_accuracy"] == 1.0
    assert load_mlp(spark, f"file://{tmp_path}/m")[0].classes == ["0", "A"]


def test_augmentation_varies_and_repeats():
    pattern = np.zeros((7, 5), np.uint8)
    pattern[:, 0] = pattern[3] = 255
    made = [images.augmented(pattern, np.random.default_rng([3, i])) for i in range(60)]
    again = [images.augmented(pattern, np.random.default_rng([3, i])) for i in range(60)]
    assert all((a == b).all() for a, b in zip(made, again, strict=True))
    assert all(a.shape == (32, 32) and a.dtype == np.uint8 and a.max() == 255 for a in made)
    assert len({a.tobytes() for a in made}) == 60
    ink = [int((a > 0).sum()) for a in made]
    assert max(ink) > 1.3 * min(ink)


def test_pattern_of_each_character():
    made = [images.bar_font(c) for c in images.CHARS]
    assert len({a.tobytes() for a in made}) == 36 == len(set(images.BARS.values()))
    labels = [kernels.label(a) for a in made]
    assert all(a.shape == (29, 21) and len(kernels.stats(*got)) == 1 for a, got in zip(made, labels, strict=True))
