"""What is fetched from where, and the command that fetches it into a lake.

    python -m ledgerweave.sources.connectors LAKE 2024-01-01 --register URL --review URL --year 2024 --laws URL --law ID --law ID

A connector is a name of a file and a function that fetches and looks at its bytes: an address that isn't there may answer with the page of an application, which
would be kept for good. Nothing is written before it was looked at, and one source's failure doesn't stop the others.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import SparkSession

from .layouts import FILES
from .registry import fetch_all
from .rest import get

Fetcher = Callable[[], bytes]


class UnexpectedContent(Exception):
    """An answer that isn't what was asked for."""


def _archive(url: str) -> Fetcher:
    def fetch() -> bytes:
        content = get(url)
        if not content.startswith(b"PK"):
            raise UnexpectedContent(f"{url} isn't an archive: {content[:32]!r}")
        return content

    return fetch


def register(url: str) -> dict[str, Fetcher]:
    """The corporate register, one archive of all corporations."""
    return {"register.zip": _archive(url)}


def review(url: str, year: int, groups: tuple[str, ...] = tuple(FILES)) -> dict[str, Fetcher]:
    """The budget review of a year, an archive for each group; names of files are quoted in addresses."""
    if unknown := sorted(set(groups) - set(FILES)):
        raise ValueError(f"unknown groups: {unknown}")
    names = {g: FILES[g].format(year=year) for g in groups}
    return {f"{n}.zip": _archive(f"{url}/{year}/{quote(n)}.zip") for n in names.values()}


def law(url: str, law_id: str) -> dict[str, Fetcher]:
    """The document of one law, which must be JSON with the text of the law; every law has a file of its own."""

    def fetch() -> bytes:
        content = get(f"{url}/{quote(law_id)}")
        try:
            document = json.loads(content)
        except ValueError as e:
            raise UnexpectedContent(f"the answer for law {law_id} isn't JSON: {content[:64]!r}") from e
        if not isinstance(document, dict) or "law_full_text" not in document:
            raise UnexpectedContent(f"the answer for law {law_id} has no text of the law")
        return content

    return {f"law_data_{law_id}.json": fetch}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Fetches what the arguments name; prints a line for each source, and returns 1 if one of them failed."""
    parser = argparse.ArgumentParser(prog="ledgerweave.sources.connectors")
    parser.add_argument("lake")
    parser.add_argument("date")
    parser.add_argument("--register", metavar="URL")
    parser.add_argument("--review", metavar="URL")
    parser.add_argument("--year", type=int)
    parser.add_argument("--group", action="append")
    parser.add_argument("--laws", metavar="URL")
    parser.add_argument("--law", action="append", default=[], metavar="ID")
    asked = parser.parse_args(arguments)
    if bool(asked.review) != bool(asked.year) or bool(asked.laws) != bool(asked.law):
        parser.error("--review needs --year, and --laws needs --law")
    wanted: dict[str, dict[str, Fetcher]] = {}
    if asked.register:
        wanted["houjin-bangou"] = register(asked.register)
    if asked.review:
        wanted["rs-system"] = review(asked.review, asked.year, tuple(asked.group or FILES))
    if asked.laws:
        wanted["egov-law-data"] = {name: f for i in asked.law for name, f in law(asked.laws, i).items()}
    said = fetch_all(spark or SparkSession.builder.getOrCreate(), asked.lake, asked.date, wanted)
    for source, how in said.items():
        print(f"{source}: {how}")
    return int(any(how.startswith("failed") for how in said.values()))


if __name__ == "__main__":
    sys.exit(main())
