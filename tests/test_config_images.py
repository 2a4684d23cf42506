import numpy as np
import pytest

from pagemill.operators import images
from pagemill.sources import settings as C


def test_settings_round_trip_and_defaults(tmp_path):
    path = str(tmp_path / "s" / "settings.json")
    assert C.read_settings(path) == C.Settings()
    C.write_settings(path, C.Settings("Auto", "EnglishRussian", True))
    assert C.read_settings(path) == C.Settings("Accurate", "Russian", True)
    (tmp_path / "broken.json").write_text("{")
    assert C.read_settings(str(tmp_path / "broken.json")) == C.Settings()


def test_registration_comes_first(tmp_path):
    path, calls = str(tmp_path / "x.json"), []

    def fails(on):
        calls.append(on)
        raise OSError

    with pytest.raises(OSError):
        C.saved(C.Settings(start_with_system=True), path, fails)
    assert calls == [True] and C.read_settings(path) == C.Settings()
    assert C.reconciled(C.Settings(), lambda: True).start_with_system


def test_model_folder(tmp_path):
    (tmp_path / "b").mkdir()
    for n in ("eng", "rus"):
        (tmp_path / "b" / f"{n}.traineddata").touch()
    assert C.model_folder([str(tmp_path / "a"), str(tmp_path / "b")], "EnglishRussian") == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError, match="eng.traineddata"):
        C.model_folder([str(tmp_path)], "English")


def test_log_rotates(tmp_path):
    log = C.RotatingLog(str(tmp_path / "log"), limit=20, keep=2)
    for i in range(6):
        log.write(f"line {i} 12345678")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["log", "log.1", "log.2"]


def test_image_statistics(spark):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (20, 16, 4), dtype=np.uint8)
    y = np.rint(0.114 * pixels[..., 0] + 0.587 * pixels[..., 1] + 0.299 * pixels[..., 2])
    edges = np.concatenate([np.abs(np.diff(y, axis=0)).ravel(), np.abs(np.diff(y, axis=1)).ravel()]).sum() / (255 * (19 * 16 + 20 * 15))
    df = spark.createDataFrame([("d", 16, 20, 64, bytearray(pixels.tobytes()))], "doc_id string, width int, height int, stride int, pixels binary")
    r = images.image_stats(df).first()
    assert r.avg_luminance == pytest.approx(y.mean()) and r.contrast_range == y.max() - y.min() and r.edge_density == pytest.approx(edges)
    assert images.ink_histogram(df).count() == 20
    assert images.enhanced(df).first().stride == 64
    assert images.cropped(pixels, -3, 2, 5, 99).shape == (18, 5, 4)
