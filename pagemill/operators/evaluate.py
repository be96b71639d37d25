"""Extraction quality: which of the wanted passages stay in a page's Markdown, and which of the boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.pages import page_udf


class _Corpus:
    """Four small pages of own wording: one article, a manual, plain divisions, and cards without a main part."""

    SCHEMA = "name string, html string, required array<string>, boilerplate array<string>, expected_empty boolean"

    @staticmethod
    def rows() -> list[tuple]:
        long = "The mill grinds pages, slowly and with care, until words are left; what was round them stays behind. " * 3
        article = f"<nav>Start Shop Help</nav><aside>Buy now</aside><article><h1>Mills</h1><p>{long}</p><p>Second part, <a href='/w'>with water</a>.</p><table><tr><th>Stone</th></tr><tr><td>Granite</td></tr></table></article><footer>Imprint</footer>"
        manual = f"<header>Manual bar</header><nav>Contents</nav><main><h1>Use</h1><p>{long}</p><pre><code>mill --all</code></pre></main><footer>License note</footer>"
        plain = f"<div class='masthead'>Top bar</div><div class='navigation'>One Two</div><div class='story content'><p>{long}</p><p>{long} End of it.</p></div><div class='footer'>Bottom</div>"
        cards = "".join(f"<article><h2>Card {k}</h2><p>Short teaser {k}</p></article>" for k in range(3))
        page = "<html lang='en'><head><title>T</title></head><body>{}</body></html>".format
        return [
            ("article", page(article), ["Mills", "with water", "Granite"], ["Buy now", "Imprint", "Shop"], False),
            ("manual", page(manual), ["Use", "mill --all"], ["Manual bar", "License note", "Contents"], False),
            ("plain", page(plain), ["words are left", "End of it"], ["Top bar", "One Two", "Bottom"], False),
            ("cards", page(cards), [], ["Card 0", "Card 1", "Card 2"], True),
        ]

    def df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), self.SCHEMA)


CORPUS = _Corpus()


def scores(fixtures: DataFrame, modes: tuple[str, ...] = ("full", "main")) -> DataFrame:
    """name, engine -> recall of the required, rejection of the boilerplate (null: none listed), whether it came out empty as it should, and
    characters. Every fixture meets every engine: a small list against a small list."""
    out = None
    for mode in modes:
        page = page_udf(mode, want=("markdown",))
        part = fixtures.select("*", page("html", F.concat(F.lit("https://fixtures.example/"), "name"))["markdown"].alias("md")).withColumn("engine", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    md = F.coalesce("md", F.lit(""))
    share = lambda kept, of: F.when(F.size(of) > 0, kept / F.size(of))
    return out.select(
        "name", "engine",
        share(F.size(F.filter("required", lambda m: F.contains(md, m))), F.col("required")).alias("recall"),
        share(F.size(F.filter("boilerplate", lambda m: ~F.contains(md, m))), F.col("boilerplate")).alias("rejection"),
        ((md == "") == F.col("expected_empty")).alias("honest"), F.length(md).cast("bigint").alias("characters"),
    )
