"""Tracked changes: text with markers of insertions, deletions, moves, comments and notes, as a stream of tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = re.compile(r"(</?(?:INS|DEL|MOVEFROM|MOVETO|COMMENT_START|COMMENT_END|COMMENT_REF|FOOTNOTE_REF|ENDNOTE_REF)\b[^>]*>)")
#: What each kind of change is called, and where it is counted.
CHANGES = {"INS": ("insertion", "insertions"), "DEL": ("deletion", "deletions"), "MOVEFROM": ("move_from", "moves"), "MOVETO": ("move_to", "moves")}
CHANGE = "struct<tag:string,kind:string,id:string,author:string,date:string>"
SCHEMA = f"tokens array<struct<type:string,text:string,id:string,kind:string,changes:array<{CHANGE}>,comment_ids:array<string>>>, insertions int, deletions int, moves int, comments int, notes int"


def tokens(text: str) -> dict:
    """The tokens of one text and the number of its changes. A marker without its fellow loses no text."""
    out, counts = [], dict.fromkeys(("insertions", "deletions", "moves", "comments", "notes"), 0)
    changes: list[dict] = []
    comments: list[str] = []
    seen: set[str] = set()

    def add(type_: str, **more) -> None:
        out.append({"type": type_, "text": None, "id": None, "kind": None, "changes": [], "comment_ids": []} | more)

    def comment(name: str | None) -> None:
        if name and name not in seen:
            seen.add(name)
            counts["comments"] += 1

    for k, part in enumerate(MARKER.split(text)):
        if not k % 2:
            for piece in filter(None, re.split(r"([\n\t])", part)):
                if piece in "\n\t":
                    add("break" if piece == "\n" else "tab")
                else:
                    add("text", text=piece, changes=[dict(c) for c in changes], comment_ids=list(comments))
            continue
        told = dict(re.findall(r'(\w+)="([^"]*)"', part))
        tag, name = re.match(r"</?(\w+)", part)[1], told.get("id")
        if tag in CHANGES:
            if part[1] == "/":
                last = max((i for i, c in enumerate(changes) if c["tag"] == tag), default=None)
                if last is not None:
                    del changes[last]
            else:
                kind, counted = CHANGES[tag]
                counts[counted] += 1
                changes.append({"tag": tag, "kind": kind, "id": name, "author": told.get("author") or None, "date": told.get("date") or None})
        elif tag == "COMMENT_START":
            comment(name)
            if name and name not in comments:
                comments.append(name)
        elif tag == "COMMENT_END":
            comments[:] = [c for c in comments if c != name]
        elif tag == "COMMENT_REF":
            comment(name)
            add("comment_ref", id=name)
        else:
            counts["notes"] += 1
            add("note_ref", id=name, kind="footnote" if tag.startswith("FOOT") else "endnote")
    return {"tokens": out} | counts


def _walk(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tokens(t or "") for t in texts], columns=["tokens", "insertions", "deletions", "moves", "comments", "notes"])


def revision_tokens(c: Column) -> Column:
    """tokens() of each text; none of a null. Arrow batches: the walk has an order that no expression has."""
    return F.pandas_udf(_walk, SCHEMA)(c)
