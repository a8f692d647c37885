"""Seed urls: built-in sets, files of sets, and which seeds a crawl starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Seed sets.
SEEDS = {
    "general": "https://example.com https://httpbin.org https://www.wikipedia.org https://github.com https://stackoverflow.com https://reddit.com https://news.ycombinator.com https://mozilla.org https://w3.org https://www.json.org".split(),
    "programming": "https://github.com https://stackoverflow.com https://developer.mozilla.org https://docs.rs https://pkg.go.dev https://python.org https://nodejs.org https://rust-lang.org https://go.dev https://www.typescriptlang.org https://react.dev https://nextjs.org https://vuejs.org https://lodash.com https://expressjs.com https://fastify.io https://www.freecodecamp.org https://www.theodinproject.com".split(),
    "academic": "https://scholar.google.com https://arxiv.org https://www.researchgate.net https://www.jstor.org https://www.nature.com https://www.science.org https://www.ieee.org https://dl.acm.org https://www.springer.com https://onlinelibrary.wiley.com https://www.ncbi.nlm.nih.gov https://www.semanticscholar.org https://www.doaj.org https://www.coursera.org https://www.edx.org https://www.mit.edu https://www.stanford.edu".split(),
}


class SeedError(ValueError):
    pass


def seed_table(spark: SparkSession, sets: dict[str, list[str]] | None = None) -> DataFrame:
    """(set_name, ord, url)."""
    rows = [(name, i, url) for name, urls in (SEEDS if sets is None else sets).items() for i, url in enumerate(urls)]
    return spark.createDataFrame(rows, "set_name string, ord int, url string")


def parse_seed_file(text: str) -> tuple[dict[str, list[str]], str | None]:
    """Sets of a seed file and its default: [name] heads a set, then one url a line; # starts a comment; default=name may stand anywhere. SeedError if no set has urls."""
    sets: dict[str, list[str]] = {}
    default, name = None, None
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] == "#":
            continue
        if line[0] == "[" and line[-1] == "]":
            name = line[1:-1]
            sets[name] = []
        elif line.lower().startswith("default="):
            default = line.partition("=")[2].strip().lower()
        elif name is not None:
            sets[name].append(line)
    sets = {k: v for k, v in sets.items() if v}
    if not sets:
        raise SeedError("no seed set in file")
    return sets, default


def read_seed_file(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # a configuration file
    sets, default = parse_seed_file(text)
    return seed_table(spark, sets), default


def resolve_seeds(urls: list[str] = (), set_name: str | None = None, file_sets: dict[str, list[str]] | None = None, default: str | None = None) -> list[str]:
    """Given urls first, else a set (of the file before the built-in ones), else the file's default. Blank and malformed ones are refused."""
    if urls:
        chosen = list(urls)
    else:
        name = set_name or default
        sets = SEEDS | (file_sets or {})
        if not name or name not in sets:
            raise SeedError(f"seed set {name!r} not found; there are {', '.join(sorted(sets))}")
        chosen = sets[name]
    bad = [u for u in chosen if not u.strip().startswith(("http://", "https://"))]
    if bad:
        raise SeedError(f"seed url must start with http:// or https://: {bad[0]!r}")
    return list(dict.fromkeys(u.strip() for u in chosen))


def merge(seeds: DataFrame, urls: DataFrame) -> DataFrame:
    return seeds.select("url").unionByName(urls.select("url"))


def valid(seeds: DataFrame) -> DataFrame:
    return seeds.where(F.trim("url").rlike("^https?://"))
