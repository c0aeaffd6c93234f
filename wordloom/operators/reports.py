"""Reports of results as JSON, CSV and Markdown, sizes for people, settings, and the choice of tensors under a budget."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
#: Rows of a report; more go to a table of their own.
REPORT_ROWS = 10_000


def human_bytes(n: float) -> str:
    for unit in UNITS:
        if abs(n) < 1024 or unit == UNITS[-1]:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def rows_of(report: DataFrame) -> list[dict]:
    """The rows of a report, which is one by being short."""
    rows = [r.asDict(recursive=True) for r in report.limit(REPORT_ROWS + 1).collect()]
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has {REPORT_ROWS} rows at most: write the table instead")
    return rows


def as_json(rows: list[dict], **about: object) -> str:
    return json.dumps(about | {"rows": rows}, indent=2, sort_keys=True, default=str)


def as_csv(rows: list[dict]) -> str:
    out = io.StringIO()
    writer = csv.DictWriter(out, list(rows[0]) if rows else [], lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def as_markdown(rows: list[dict], title: str = "") -> str:
    head = list(rows[0]) if rows else []
    text = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", ""] * bool(title) + ["| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(text(r[c]) for c in head) + " |" for r in rows]) + "\n"


def settings(text: str, known: Iterable[str]) -> dict:
    """Settings from JSON, or from lines `name: value` of a flat YAML file, which need no library. Unknown names are refused."""
    if text.lstrip().startswith("{"):
        out = json.loads(text)
    else:
        out = {}
        for line in text.splitlines():
            line = re.sub(r"(^|\s)#.*", "", line).rstrip()
            if not line:
                continue
            name, colon, value = line.partition(":")
            if not colon or line[0] in " \t-":
                raise ValueError(f"only flat settings are read: {line!r}")
            out[name.strip()] = _value(value.strip())
    if odd := set(out) - set(known):
        raise ValueError(f"unknown settings: {sorted(odd)}")
    return out


def _value(text: str) -> object:
    if text in ("", "~", "null"):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text.strip("'\"")


def layer_of(name: str) -> int | None:
    found = re.search(r"(?:layers|blocks|h)[.](\d+)[.]", name)
    return int(found[1]) if found else None


def is_linear(name: str) -> bool:
    return name.endswith("weight") and not re.search(r"norm|embed|wte|lm_head", name)


def is_embedding(name: str) -> bool:
    return bool(re.search(r"embed_tokens|wte|embedding", name))


def _eligible(inventory: list[dict], embeddings: bool) -> list[dict]:
    wide = [t for t in inventory if t["dtype"] in ("BF16", "F16", "FP16") and len(t["shape"]) == 2]
    own = [t for t in wide if is_linear(t["name"]) or embeddings and is_embedding(t["name"])]
    return own or wide


def select_tensors(inventory: list[dict], least: int, most: int, embeddings: bool = False) -> list[dict]:
    """Tensors (name, dtype, shape, nbytes) of the first, the middle and the last layer, then the others in order, as far
    as a budget of `most` bytes goes; where that gives under `least`, the largest left over. An inventory has one row a
    tensor, some thousands at most."""
    eligible = _eligible(inventory, embeddings)
    layers = sorted({n for t in eligible if (n := layer_of(t["name"])) is not None})
    first = [layers[0], layers[len(layers) // 2], layers[-1]] if layers else []
    order = list(dict.fromkeys([*first, *layers]))
    groups = [sorted((t for t in eligible if layer_of(t["name"]) == n), key=lambda t: t["name"]) for n in order]
    groups.append(sorted((t for t in eligible if layer_of(t["name"]) is None), key=lambda t: -t["nbytes"]))
    chosen: dict[str, dict] = {}
    total = 0
    for tensor in (t for g in groups for t in g):
        alone = not chosen and tensor["nbytes"] > most and total < least
        if total < most and (total + tensor["nbytes"] <= most or alone):
            chosen[tensor["name"]] = tensor
            total += tensor["nbytes"]
    for tensor in sorted(eligible, key=lambda t: -t["nbytes"]):
        if total >= least:
            break
        if tensor["name"] not in chosen and (total + tensor["nbytes"] <= most or not chosen):
            chosen[tensor["name"]] = tensor
            total += tensor["nbytes"]
    return list(chosen.values())


def select_remaining(inventory: list[dict], already: list[dict], most: int, count: int = 4) -> list[dict]:
    """Up to `count` tensors that were not chosen, embeddings first, then the largest, within a budget."""
    names = {t["name"] for t in already}
    rest = [t for t in inventory if t["dtype"] in ("BF16", "F16", "FP16") and len(t["shape"]) == 2 and t["name"] not in names]
    out, total = [], 0
    for tensor in sorted(rest, key=lambda t: (not is_embedding(t["name"]), -t["nbytes"], t["name"])):
        if len(out) < count and (not out or total < most and total + tensor["nbytes"] <= most):
            out.append(tensor)
            total += tensor["nbytes"]
    return out


def resumed(done: list[dict], recipe: dict, layers: list[str]) -> list[str]:
    """The layers still to do. What was done (recipe and layer each) has to be of the same recipe and a prefix of them."""
    if any(d["recipe"] != recipe for d in done):
        raise ValueError("earlier layers are of another recipe")
    names = [d["layer"] for d in done]
    if names != layers[: len(names)]:
        raise ValueError("earlier layers are not the first ones")
    return layers[len(names) :]
