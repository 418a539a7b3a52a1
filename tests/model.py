"""A small plain model of the inference, to check the job against by brute force."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass
class Model:
    """``uses``: (version, path, checksum). ``crawl``: url -> (status, checksum)."""

    uses: list[tuple[int, str, str]]
    n_versions: int
    crawl: dict[str, tuple[int, str]]
    min_support: float = 0.2
    min_absolute: float = 10.0
    weights: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        for checksum in {c for _, _, c in self.uses}:
            users = len({v for v, _, c in self.uses if c == checksum})
            self.weights[checksum] = round(math.log(self.n_versions / users) / math.log(10) * 1e6)

    def fetch(self, url: str) -> tuple[str, str | None]:
        status, checksum = self.crawl.get(url, (404, None))
        return url, checksum if status == 200 else None

    @staticmethod
    def path_of(url: str) -> str:
        return url.split("/", 3)[3] if url.count("/") > 2 else ""

    def guesses(self, assets: dict[str, str | None]) -> list[tuple[int, int, int]]:
        """Ranked (version, strength in nano, positive micro)."""
        pos: dict[int, int] = {}
        neg: dict[int, int] = {}
        for url, checksum in assets.items():
            using = {v for v, _, c in self.uses if c == checksum}
            expected = {v for v, p, _ in self.uses if p == self.path_of(url)}
            weight = self.weights.get(checksum, 1_000_000) if checksum else 1_000_000
            for version in using | expected:
                side = pos if version in using else neg
                side[version] = side.get(version, 0) + weight
        ranked = sorted(
            ((v, pos.get(v, 0) * 1000 + neg.get(v, 0) * 100, pos.get(v, 0)) for v in pos.keys() | neg.keys()),
            key=lambda g: (-g[1], g[0]),
        )[:7]
        if not ranked or ranked[0][2] / 1e6 < 2:
            return ranked
        best = ranked[0][1] / 1e9
        return [g for g in ranked if g[1] / 1e9 >= min((1 - 0.3) * best, best - 3)]

    @staticmethod
    def decisiveness(guesses) -> float:
        if not guesses:
            return 0.0
        best = guesses[0][1]
        if len(guesses) == 1:
            return best / 1e9
        return sum(best - g[1] for g in guesses) / len(guesses) / 1e9

    def base_url(self, base: str, assets: dict[str, str | None]) -> str:
        votes: dict[str, int] = {}
        for url, checksum in assets.items():
            seen, found = self.path_of(url), set()
            for expected in {p for _, p, c in self.uses if checksum and c == checksum}:
                if expected == seen or not expected or not seen:
                    continue
                if expected.endswith(seen):
                    found.add(expected.replace(seen, ""))
                elif seen.endswith(expected):
                    found.add("/" + seen.replace(expected, ""))
            for path in found:
                votes[path] = votes.get(path, 0) + 1
        if not votes:
            return base
        path = min(votes, key=lambda b: (-votes[b], b))
        host = "/".join(base.split("/")[:3]) + "/"
        return (host if path.startswith("/") else base) + path.lstrip("/")

    def infer(self, base: str, included: list[str], estimates: list[int]):
        assets = dict(self.fetch(url) for url in included)
        base = self.base_url(base, assets)
        url, checksum = self.fetch(base + "favicon.ico")
        assets.setdefault(url, checksum)
        guesses = [(v, 0, 0) for v in sorted(estimates)] + self.guesses(assets)
        if not guesses:
            return None, 0
        streak = 0
        for number in range(1, 16):
            chosen = {g[0] for g in guesses}
            seen_paths = {self.path_of(u) for u in assets}
            options = []
            for path in {p for _, p, _ in self.uses} - seen_paths:
                versions = {v for v, p, _ in self.uses if p == path and v in chosen}
                checksums = {c for v, p, c in self.uses if p == path and v in chosen}
                same = len(chosen) > 1 and len(versions) == len(chosen) and len(checksums) == 1
                if versions and not same:
                    options.append((-(len(versions) + len(checksums)), path))
            found = 0
            served = False
            for _, path in sorted(options)[:8]:
                if found >= 2:
                    break
                url, checksum = self.fetch(base + path)
                if url in assets:
                    continue
                assets[url] = checksum
                served |= checksum is not None
                found += checksum in self.weights
            before = self.decisiveness(guesses)
            guesses = self.guesses(assets)
            gain = self.decisiveness(guesses) - before
            streak = streak + 1 if gain < 0.5 or not served else 0
            best = guesses[0][1] / 1e9 if guesses else 0.0
            enough = best / len(assets) >= self.min_support and best >= self.min_absolute
            if not guesses or streak >= 3 or (len(guesses) == 1 and enough) or number == 15:
                if not guesses or not enough:
                    return None, number
                return sorted(g[0] for g in guesses if g[1] == guesses[0][1]), number
        raise AssertionError
