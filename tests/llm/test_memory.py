"""What operators hold at once, and what they leave behind."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa

from ledgerweave.llm import near_copies, recompression
from ledgerweave.llm.shared import map_batches, shared_folder


def test_words_are_forgotten_and_results_sliced():
    recompression._words.of([b"one", b"two"])
    recompression._forget()
    assert not recompression._words
    name = np.arange(2 * recompression.ROWS + 1)
    parts = [x["name"] for x in recompression._sliced({"name": name})]
    assert max(map(len, parts)) <= recompression.ROWS and (np.concatenate(parts) == name).all()


def test_texts_come_in_slices():
    batch = pa.RecordBatch.from_pydict({"t": [str(i) for i in range(2 * near_copies.SLICE + 1)]})
    parts = list(near_copies._slices(batch))
    assert max(p.num_rows for p in parts) <= near_copies.SLICE and [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_a_task_ends_with_done(spark, tmp_path):
    mark = str(tmp_path / "done")
    rows = map_batches(spark.range(5), lambda batch: {"id": batch.column(0)}, "id long", lambda: Path(mark).touch())
    assert rows.count() == 5 and Path(mark).exists()


def test_sets_of_shingles_are_deleted(spark, monkeypatch):
    kept, keep = [], near_copies.Scratch.keep

    def noted(self, name, df):
        kept.append((name, f"{self.folder}/{name}"))
        return keep(self, name, df)

    monkeypatch.setattr(near_copies.Scratch, "keep", noted)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30)) + f" x{i}") for i in range(4)], "doc_id long, text string")
    assert near_copies.keep_one(docs).count() == 1 and shared_folder(spark)
    assert {"whole", "sets"} <= {name for name, _ in kept}
    assert not any(Path(path.removeprefix("file:")).exists() for _, path in kept)
