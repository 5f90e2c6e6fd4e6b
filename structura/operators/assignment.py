"""Decisions of one project that depend on those before them: who keeps a contested target, who takes a free one."""

from __future__ import annotations

import json
import re
from collections import defaultdict

KEY = re.compile(r"p(\d+)-a(\d+)-v(\d+)-k(\d+)-w(\d+)-d(\d+)-kd(\d+)")


def accepts(source_key: str, target_key: str) -> bool:
    """Whether a target can be called with the reference's positional arguments, needing no more by keyword."""
    s, t = KEY.fullmatch(source_key), KEY.fullmatch(target_key)
    if not s or not t:
        return True
    sp, sa, _, sk, _, _, skd = map(int, s.groups())
    tp, ta, tv, tk, _, td, tkd = map(int, t.groups())
    given, room = sp + sa, tp + ta
    return room - td <= given and (bool(tv) or given <= room) and tk - tkd <= sk - skd


def _order(e: dict) -> tuple:
    return e["module"], e["qualname"], e["kind"], e["signature_key"], e["path"], e["lineno"], e["canonical_id"]


def _dunder(name: str) -> bool:
    return name.startswith("__") and name.endswith("__")


class _Project:
    def __init__(self, what: list[str], rows: list[str], reference: list[dict], config):
        self.config = config
        data = defaultdict(list)
        for kind, row in zip(what, rows):
            data[kind].append(json.loads(row))
        self.matches = {m["source_id"]: m for m in data["match"]}
        for m in self.matches.values():
            m.setdefault("target_id", None)
            m.setdefault("stage", None)
            m["candidates"] = m.get("candidates") or []
        self.pairs = {p["reference"]: p["to"] for p in data["pair"]}
        self.sources = sorted(reference, key=_order)
        self.targets = sorted(data["target"], key=_order)
        self.target = {t["canonical_id"]: t for t in self.targets}

    def matched(self) -> dict[str, str]:
        return {m["target_id"]: i for i, m in self.matches.items() if m["status"] == "MATCHED" and m["target_id"]}

    def give(self, source_id: str, target_id: str, stage: str) -> None:
        self.matches[source_id] |= {"target_id": target_id, "status": "MATCHED", "confidence": 1.0 if stage == "mapping" else self.matches[source_id]["confidence"], "stage": stage}

    # the best match keeps a target; the others, best first, take their best free candidate

    def one_to_one(self) -> None:
        def rank(m: dict) -> tuple:
            first = m["candidates"][0] if m["candidates"] else None
            return m["confidence"], first["n"] if first and first["t"] == m["target_id"] else 0.0, m["source_id"]

        holders = defaultdict(list)
        for m in self.matches.values():
            if m["status"] == "MATCHED" and m["target_id"]:
                holders[m["target_id"]].append(m)
        taken = set(holders)
        losers = [m for own in holders.values() for m in sorted(own, key=rank, reverse=True)[1:]]
        c = self.config
        for m in sorted(losers, key=rank, reverse=True):
            free = [x for x in m["candidates"] if x["t"] not in taken]
            if not free:
                m |= {"target_id": None, "status": "UNMATCHED", "confidence": 0.0}
                continue
            best, rival = free[0], free[1] if len(free) > 1 else None
            if best["c"] >= c.threshold and rival and rival["c"] >= best["c"] - c.delta:
                status = "AMBIGUOUS"
            elif best["c"] >= c.threshold:
                status = "MATCHED"
                taken.add(best["t"])
            else:
                status = "LOW_CONFIDENCE" if best["c"] >= c.min_candidate else "UNMATCHED"
            m |= {"target_id": None if status == "UNMATCHED" else best["t"], "status": status, "confidence": best["c"]}

    # pairs that a mapping names, checked; entities before modules, which also pair what bears the same name

    def mapped(self) -> None:
        def named(rows: list[dict]) -> dict[str, list[dict]]:
            out = defaultdict(list)
            for e in rows:
                name = e["module"] if e["kind"] == "module" else ".".join(filter(None, (e["module"], e["qualname"])))
                out[name or "__init__"].append(e)
            return out

        sources, targets, by_mapping = named(self.sources), named(self.targets), set()

        def pair(s: dict, t: dict) -> None:
            m = self.matches.get(s["canonical_id"])
            if m is None or m["status"] == "MATCHED" or s["kind"] != t["kind"]:
                return
            if t["kind"] != "module" and t["canonical_id"] in self.matched():
                return
            if s["kind"] in ("function", "method") and not accepts(s["signature_key"], t["signature_key"]):
                return
            self.give(s["canonical_id"], t["canonical_id"], "mapping")
            by_mapping.add(s["canonical_id"])

        def only(rows: list[dict], kind: str | None = None) -> dict | None:
            rows = [r for r in rows if kind is None or r["kind"] == kind]
            return rows[0] if len(rows) == 1 else None

        is_module = lambda name: any(e["kind"] == "module" for e in sources.get(name, []))
        for name in sorted(sorted(self.pairs), key=is_module):
            own, to = sources.get(name, []), self.pairs[name]
            if not own:
                continue
            if not is_module(name):
                t = only(targets.get(to, []))
                if t:
                    pair(own[0], t)
                continue
            t = only(targets.get(to, []), "module")
            if t is None:
                continue
            pair(next(e for e in own if e["kind"] == "module"), t)
            for s in self.sources:
                if s["kind"] != "module" and s["module"] == ("" if name == "__init__" else name) and s["canonical_id"] not in by_mapping:
                    twin = only(targets.get(f"{to}.{s['qualname']}", []), s["kind"])
                    if twin:
                        pair(s, twin)

    # names that are unique on both sides, then methods of classes that are paired

    def by_name(self) -> None:
        taken = set(self.matched())
        claims: dict[str, tuple[float, str]] = {}
        for m in self.matches.values():
            if m["status"] != "MATCHED" and m["candidates"]:
                best = m["candidates"][0]
                claims[best["t"]] = max(claims.get(best["t"], (-1.0, "")), (best["c"], m["source_id"]))
        named = lambda rows: [(r["kind"], r["name"]) for r in rows]
        source_names = named(self.sources)
        for s in self.sources:
            m = self.matches.get(s["canonical_id"])
            if m is None or m["status"] == "MATCHED" or s["kind"] not in ("class", "function") or "." in s["qualname"] or source_names.count((s["kind"], s["name"])) != 1:
                continue
            pool = [t for t in self.targets if (t["kind"], t["name"]) == (s["kind"], s["name"]) and "." not in t["qualname"]]
            if len(pool) != 1:
                continue
            t = pool[0]["canonical_id"]
            open_for = m["status"] == "UNMATCHED" or not m["candidates"] or m["candidates"][0]["t"] == t
            claimed = claims.get(t)
            if not open_for or t in taken or (claimed and claimed[1] != s["canonical_id"]) or not accepts(s["signature_key"], pool[0]["signature_key"]):
                continue
            if s["kind"] == "class" and not self.class_fits(s, pool[0]):
                continue
            self.give(s["canonical_id"], t, "unique_name")
            taken.add(t)
        pairs = {(s["module"], s["qualname"]): self.target[m["target_id"]] for s in self.sources if s["kind"] == "class" and (m := self.matches.get(s["canonical_id"])) and m["status"] == "MATCHED" and m["target_id"] in self.target}
        for s in self.sources:
            m = self.matches.get(s["canonical_id"])
            owner, _, name = s["qualname"].rpartition(".")
            home = pairs.get((s["module"], owner))
            if s["kind"] != "method" or m is None or m["status"] == "MATCHED" or home is None:
                continue
            t = next((t for t in self.targets if t["kind"] == "method" and t["module"] == home["module"] and t["qualname"] == f"{home['qualname']}.{name}" and t["canonical_id"] not in taken and accepts(s["signature_key"], t["signature_key"])), None)
            if t:
                self.give(s["canonical_id"], t["canonical_id"], "member_of_paired_class")
                taken.add(t["canonical_id"])

    def methods(self, rows: list[dict], module: str, owner: str) -> list[dict]:
        return [r for r in rows if r["kind"] == "method" and r["module"] == module and r["qualname"].rpartition(".")[0] == owner]

    def class_fits(self, s: dict, t: dict) -> bool:
        """Whether a target class has all ordinary methods of a source's, none of them paired with another class's."""
        wanted = [m for m in self.methods(self.sources, s["module"], s["qualname"]) if not _dunder(m["name"])]
        if {m["name"] for m in wanted} - {m["name"] for m in self.methods(self.targets, t["module"], t["qualname"])}:
            return False
        for m in wanted:
            own = self.matches.get(m["canonical_id"])
            other = self.target.get(own["target_id"] or "") if own and own["status"] == "MATCHED" else None
            if other and (other["module"], other["qualname"].rpartition(".")[0]) != (t["module"], t["qualname"]):
                return False
        return True


def settle_rows(what: list[str], rows: list[str], reference: list[dict], config) -> list[dict]:
    p = _Project(what, rows, reference, config)
    p.one_to_one()
    if p.pairs:
        p.mapped()
    if config.name_fallback:
        p.by_name()
    keep = ("source_id", "target_id", "status", "confidence", "stage")
    return [{k: m.get(k) for k in keep} for m in p.matches.values()]
