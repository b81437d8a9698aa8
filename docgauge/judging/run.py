"""Prompts of a DataFrame answered by a client."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.judging.clients import Client
from docgauge.session import cut
from docgauge.sinks import paths
from docgauge.sources.pdf import pictures


#: Calls of a task at a time; further tries of a failed call, and seconds before the first of them (doubled each time).
PARALLEL, RETRIES, WAIT = 4, 2, 1.0
#: Errors that another try may mend: of the network and of time.
PASSING = (OSError, TimeoutError)


def tried(call: Callable[[], str], retries: int = RETRIES, wait: float = WAIT) -> tuple[str | None, str | None]:
    """(answer, None) of a call or (None, name of its last error). Only passing errors are tried again."""
    for n in range(retries + 1):
        try:
            return call(), None
        except Exception as e:
            if n == retries or not isinstance(e, PASSING):
                return None, type(e).__name__
            time.sleep(wait * 2**n)
    raise AssertionError


def answer(rows: DataFrame, client: Callable[[], Client], prompt: str = "prompt", parallel: int = PARALLEL, retries: int = RETRIES, wait: float = WAIT) -> DataFrame:
    """Add ``response`` and ``error`` (null or the exception's name); the result is materialised.

    The client is built once per task and asked ``parallel`` prompts at a time, so the calls under way are at most that
    many times the cores. A failing call never fails the task. Calls are neither repeated nor reordered by the optimizer,
    since the answers are cut off from their lineage before anything reads them.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", response string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Client] = []

        def ask(p: str) -> str:
            if not held:
                held.append(client())
            return held[0].ask(p)

        with ThreadPoolExecutor(max(1, parallel)) as pool:
            for pdf in batches:
                got = list(pool.map(lambda p: tried(lambda: ask(p), retries, wait), pdf[prompt]))
                yield pdf.assign(response=pd.Series([g[0] for g in got], dtype=object, index=pdf.index), error=pd.Series([g[1] for g in got], dtype=object, index=pdf.index))

    return cut(rows.mapInPandas(run, schema))


def describe_files(files: DataFrame, images: DataFrame, client: Callable[[], Client], crops: str | None = None) -> DataFrame:
    """Descriptions of the images of PDF files: doc_id, placeholder, page, context, image_path, description, error.

    ``files``: doc_id, content. ``images``: doc_id, placeholder, page, context. The images of a file are taken from it in
    one go and, with ``crops``, kept as ``crops/<doc_id>/p<page>_idx<n>.<ext>``. A failing image never fails its document.
    """
    per = images.groupBy("doc_id").agg(F.collect_list(F.struct("placeholder", "page", "context")).alias("items"))  # the images of one file
    schema = "doc_id string, placeholder string, page int, context string, image_path string, description string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = None
        for pdf in batches:
            rows = []
            for doc, content, items in zip(pdf["doc_id"], pdf["content"], pdf["items"]):
                drawn: dict[int, list[tuple[bytes, str]]] = {}
                for im in items:
                    path = ""
                    try:
                        c = c or client()
                        if im["page"] not in drawn:
                            drawn[im["page"]] = pictures(content, im["page"])
                        n = int(re.search(r"idx=(\d+)", im["placeholder"]).group(1))
                        data, ext = drawn[im["page"]][n - 1] if n <= len(drawn[im["page"]]) else (b"", "")
                        if crops and data:
                            folder = paths.join(crops, doc)
                            paths.make_folder(folder)
                            path = paths.join(folder, f"p{im['page']}_idx{n}.{ext}")
                            paths.put(path, data)
                        rows.append((doc, im["placeholder"], im["page"], im["context"], path, c.describe(data, im["context"]), None))
                    except Exception as e:
                        rows.append((doc, im["placeholder"], im["page"], im["context"], path, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return cut(files.select("doc_id", "content").join(per, "doc_id").mapInPandas(run, schema))


def failed_documents(answers: DataFrame) -> DataFrame:
    """doc_id and the first error of documents with a failed section: one failing section voids its document."""
    return answers.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))
