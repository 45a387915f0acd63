"""Recognisers that write down their calls in the folder that a path or a content names."""

import json
import uuid


def _note(folder, what):
    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
        json.dump(what, f)


def read_texts(paths):
    folder = paths[0].rsplit("/", 1)[0]
    _note(folder, len(paths))
    if any(p.endswith("/13") for p in paths):
        raise RuntimeError("this call fails")
    return {p: " " if p.endswith("/1") else f" text of {p.rsplit('/', 1)[1]} " for p in paths if not p.endswith("/2")}


def fast(content):
    word = bytes(content).decode()
    if word == "broken":
        raise RuntimeError("no")
    return [(0, 1, f"fast {word} ")] if word == "easy" else []


def slow(content):
    word = bytes(content).decode()
    return [] if word == "silence" else [(0, 1, word), (1, 2.5, "more")]
