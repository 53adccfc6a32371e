"""Kept counts equal a full run after files are added, changed, renamed and removed, and only what is new is parsed."""

import pytest
from pyspark.sql import functions as F

from voicetally.plans import incremental as I
from voicetally.plans import pipeline as P
from voicetally.sources import segments as G

TEXTS = {"a": "JOHN SMITH, GUEST: One. SMITH: Two.", "b": "SMITH, GUEST: One.\nJANE DOE, MAYOR: Two.", "c": "MARY SMITH, GUEST: One. DOE: Two.", "d": "no turns here"}


def write(folder, name, text, day=2):
    rows = [",".join(f'"{c}"' for c in G.RAW), ",".join(f'"{v}"' for v in (f"http://x.example/{name}", "NET", "P", "acd.01", "", 2001, 1, day, "20:00", "ET", "its own path", 1, "s", text))]
    (folder / f"{name}.csv").write_text("\n".join(rows) + "\n")


def same(spark, state, folder):
    cols = ["year", "sitting", "name_norm", "staff_flag", "source_mode", "office", "party", "canonical_id", "is_president", "n"]
    full = P.count_turns(G.coerce(G.read_csv(spark, f"{folder}/*.csv")), strict=False)
    by = lambda df: sorted(map(repr, df.groupBy(*cols[:-1]).agg(F.sum("n").alias("n")).select(*cols).collect()))
    return by(I.turns(spark, state)) == by(full)


def test_updates_equal_full_runs(spark, tmp_path, monkeypatch):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    parsed = []
    monkeypatch.setattr(I, "count_files", lambda s, files, own=I.count_files: parsed.append(sorted(f.rsplit("/", 1)[1] for f in files)) or own(s, files))
    go = lambda: I.update(spark, state, f"file://{folder}/*.csv")
    for name in "abd":
        write(folder, name, TEXTS[name])
    assert go() == (3, 0, 0, 0, 0) and same(spark, state, folder)
    assert go() == (0, 0, 0, 3, 1) and same(spark, state, folder)
    write(folder, "c", TEXTS["c"])  # makes SMITH of older files ambiguous
    assert go() == (1, 0, 0, 3, 2) and same(spark, state, folder)
    write(folder, "b", TEXTS["b"], day=3)
    write(folder, "a", "ANN HOST, CNN HOST: now another text.")
    (folder / "d.csv").unlink()
    assert go() == (0, 2, 1, 1, 3) and same(spark, state, folder)
    (folder / "c.csv").rename(folder / "e.csv")
    assert go() == (1, 0, 1, 2, 4) and same(spark, state, folder)
    assert parsed == [["a.csv", "b.csv", "d.csv"], [], ["c.csv"], ["a.csv", "b.csv"], ["e.csv"]]
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["v3", "v4"]


def test_failed_update_leaves_the_last_version(spark, tmp_path, monkeypatch):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    write(folder, "a", TEXTS["a"])
    I.update(spark, state, f"file://{folder}/*.csv")
    write(folder, "b", TEXTS["b"])
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(I, "count_files", lambda *_: (_ for _ in ()).throw(RuntimeError()))
        I.update(spark, state, f"file://{folder}/*.csv")
    assert I.current(spark, state) == 0 and {(r["canonical_id"], r["n"]) for r in I.turns(spark, state).collect()} == {("john smith", 2)}
    assert I.update(spark, state, f"file://{folder}/*.csv") == (1, 0, 0, 1, 1) and same(spark, state, folder)


def test_no_rows_left(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    write(folder, "d", TEXTS["d"])
    I.update(spark, state, f"file://{folder}/*.csv")
    assert I.turns(spark, state).count() == 0 and I.current(spark, str(tmp_path / "none")) is None
