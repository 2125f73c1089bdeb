"""Requests and responses of the cache's wire protocol as columns.

Requests are ``*n\\r\\n$len\\r\\ndata\\r\\n...`` or a line of words; a request ends
where its own lengths say, so a stream is cut by reading it, batch by batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arguments that a request may have; fixed value.
MOST_ARGS = 16


def requests(data: bytes) -> tuple[list[list[bytes]], int]:
    """The complete requests at the head of ``data``, and the bytes they take; the rest waits for more."""
    out: list[list[bytes]] = []
    at = 0
    while at < len(data):
        line = data.find(b"\n", at)
        if line < 0:
            break
        if data[at : at + 1] != b"*":
            words = [w for w in data[at:line].rstrip(b"\r").split(b" ") if w]
            out.append(words[:MOST_ARGS])
            at = line + 1
            continue
        n, end, args = int(data[at + 1 : line].strip() or 0), line + 1, []
        for _ in range(n):
            line = data.find(b"\n", end)
            if line < 0 or data[end : end + 1] != b"$":
                return out, at
            size = int(data[end + 1 : line].strip())
            start, end = line + 1, line + 1 + size + 2
            if end > len(data):
                return out, at
            args.append(data[start : start + size])
        out.append(args[:MOST_ARGS])
        at = end
    return out, at


def parse_streams(df: DataFrame) -> DataFrame:
    """(conn, payload) -> (conn, nth, argv): the complete requests of each connection's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, i, [a.decode("utf-8", "replace") for a in argv]) for c, p in zip(pdf["conn"], pdf["payload"], strict=True) for i, argv in enumerate(requests(bytes(p))[0])]
            yield pd.DataFrame(rows, columns=["conn", "nth", "argv"])

    return df.select("conn", "payload").mapInPandas(run, "conn long, nth int, argv array<string>")


def request(argv: Column) -> Column:
    """The wire form of an array of arguments."""
    parts = F.transform(argv, lambda a: F.concat(F.lit("$"), F.octet_length(a).cast("string"), F.lit("\r\n"), a, F.lit("\r\n")))
    return F.concat(F.lit("*"), F.size(argv).cast("string"), F.lit("\r\n"), F.array_join(parts, ""))


def response(kind: Column, value: Column) -> Column:
    """The wire form of a response."""
    return (
        F.when(kind == "BULK", F.concat(F.lit("$"), F.octet_length(value).cast("string"), F.lit("\r\n"), value, F.lit("\r\n")))
        .when(kind == "NIL", F.lit("$-1\r\n"))
        .when(kind == "OK", F.lit("+OK\r\n"))
        .when(kind == "PONG", F.lit("+PONG\r\n"))
        .when(kind == "EMPTY_ARRAY", F.lit("*0\r\n"))
        .when(kind == "INTEGER", F.concat(F.lit(":"), value, F.lit("\r\n")))
        .when(kind == "ERR", F.concat(F.lit("-ERR "), value, F.lit("\r\n")))
        .when(kind == "BACKPRESSURE", F.concat(F.lit("-BACKPRESSURE retry "), value, F.lit("\r\n")))
    )
