"""The one place for a model: a batch function over pages. No model is built in."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[list[bytes]], list[str]]


def recognize(pages: DataFrame, make_step: Callable[[], Step], batch: int = 128) -> DataFrame:
    """(doc, page, content) -> (doc, page, markdown, error): exactly one row a page.

    ``make_step`` loads the model once a task. A batch that fails is tried page by page, so
    a bad page becomes an error in its own row. The output of a page must not depend on
    what shares its batch. Null content is an error row.
    """
    kinds = dict(pages.dtypes)

    def one(step: Step, content: bytes | None) -> tuple[str | None, str | None]:
        if content is None:
            return None, "no content"
        try:
            return step([content])[0], None
        except Exception as e:  # noqa: BLE001 - what a page raises is its result
            return None, f"{type(e).__name__}: {e}"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make_step()
        for b in it:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                contents = part.column(2).to_pylist()
                try:
                    if any(c is None for c in contents):
                        raise ValueError("no content")
                    texts = step(contents)
                    if len(texts) != len(contents):
                        raise ValueError("the model gave another number of pages")
                    rows = [(t, None) for t in texts]
                except Exception:  # noqa: BLE001
                    rows = [one(step, c) for c in contents]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["doc", "page", "markdown", "error"])

    return pages.select("doc", "page", "content").mapInArrow(batches, f"doc {kinds['doc']}, page {kinds['page']}, markdown string, error string")


def inflated(data: bytes, width: int, height: int, components: int, bits: int) -> bytes:
    """A deflated sample stream of at most four times what the image needs; more is an
    error, and what is no deflate stream is taken as it is."""
    cap = 4 * width * height * components * -(-min(max(bits, 1), 16) // 8)
    worker = zlib.decompressobj()
    try:
        out = worker.decompress(data, cap + 1)
    except zlib.error:
        return data
    if len(out) > cap:
        raise ValueError("the stream inflates beyond what the image needs")
    return out
