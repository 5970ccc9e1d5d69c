"""Triples from Turtle files, whole files to a task, behind a hash lock.

Read are prefixes and bases, IRIs, prefixed names, 'a', blank node labels, literals with a language or a
datatype (long quotes too), numbers, booleans, and lists by ';' and ','. Anonymous nodes and collections
raise an error, as does anything else that isn't understood: a file is read whole or not at all.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r"(?P<space>(?:\s|#[^\n]*)+)|<(?P<iri>[^<>\"{}|^`\\\s]*)>|(?P<long>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\")|(?P<text>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<cast>\^\^)|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<name>[\w-]*:(?:[\w%-](?:[\w.%-]*[\w%-])?)?)|(?P<word>[A-Za-z]+)|(?P<mark>[;,.])",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f"}


def _plain(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES[m[3]], text, flags=re.S)


def _tokens(text: str):
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not understood at {at}: {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup != "space":
            yield m.lastgroup, m[m.lastgroup]
    yield "end", ""


def parse(text: str) -> list[tuple[str, str, str, str]]:
    """(subject, predicate, object, kind) of a Turtle text; kind is iri, blank, or a literal's datatype or
    language (the empty text for plain ones)."""
    names, base, out = {}, "", []
    tokens = list(_tokens(text))
    at = 0

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def resolve(kind: str, value: str) -> str:
        if kind == "iri":
            return value if re.match("[A-Za-z][A-Za-z0-9+.-]*:", value) else base + value
        if kind == "name":
            prefix, _, rest = value.partition(":")
            if prefix in names:
                return names[prefix] + rest
        if kind == "blank":
            return value
        raise ValueError(f"a node was expected, not {value!r}")

    def thing() -> tuple[str, str]:
        kind, value = take()
        if kind in ("text", "long"):
            value = _plain(value[3:-3] if kind == "long" else value[1:-1])
            if tokens[at][0] == "lang":
                return value, take()[1]
            if tokens[at][0] == "cast":
                take()
                return value, resolve(*take())
            return value, ""
        if kind == "number":
            return value, "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
        if kind == "word" and value in ("true", "false"):
            return value, "boolean"
        return resolve(kind, value), "blank" if kind == "blank" else "iri"

    while tokens[at][0] != "end":
        kind, value = take()
        if (kind == "lang" and value in ("@prefix", "@base")) or (kind == "word" and value.upper() in ("PREFIX", "BASE")):
            if value.lower().endswith("prefix"):
                prefix = take()[1]
                names[prefix[:-1]] = resolve(*take())
            else:
                base = resolve(*take())
            if kind == "lang" and take() != ("mark", "."):
                raise ValueError("a directive without its end")
            continue
        subject, mark = resolve(kind, value), ";"
        while mark == ";":
            if tokens[at] == ("mark", "."):  # a ';' before the end says nothing
                mark = take()[1]
                break
            kind, value = take()
            predicate, mark = TYPE if (kind, value) == ("word", "a") else resolve(kind, value), ","
            while mark == ",":
                out.append((subject, predicate, *thing()))
                kind, mark = take()
                if kind != "mark":
                    raise ValueError(f"';', ',' or '.' was expected, not {mark!r}")
    return out


def read_turtle(spark: SparkSession, path: str, sha256: dict[str, str] | None = None) -> DataFrame:
    """(file, s, p, o, kind) of the Turtle files at path. sha256: hash by file name; a file whose content
    has another, or that isn't listed, raises."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    locked = dict(sha256) if sha256 is not None else None

    def run(batches):
        import hashlib

        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                if locked is not None and locked.get(name) != hashlib.sha256(content).hexdigest():
                    raise ValueError(f"{name} isn't what was locked")
                rows = parse(content.decode("utf-8"))
                yield pd.DataFrame([(name, *r) for r in rows], columns=["file", "s", "p", "o", "kind"])

    return files.mapInPandas(run, "file string, s string, p string, o string, kind string")
