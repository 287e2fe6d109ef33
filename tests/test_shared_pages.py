"""Offers and totals of the same pages are read from one cut of the pages."""

from __future__ import annotations

from folioforge.plans import source_queries
from folioforge.sources import html, pages


def test_provider_b_pages_are_cut_once(spark, monkeypatch):
    cut = []
    keep = html.Pages.__init__
    monkeypatch.setattr(html.Pages, "__init__", lambda self, *a: (cut.append(a), keep(self, *a))[1])
    found = source_queries.provider_b_pages(spark, "/root/testdata/sf0.001")
    assert len(cut) == 1
    df, _, _ = cut[0]
    alone = pages.offer_pages(df, "part", "html").select("part", "isbn", "title", "price", "status").join(pages.offer_totals(df, "part", "html").select("part", "total"), "part")
    assert sorted(map(tuple, found.select(*alone.columns).collect())) == sorted(map(tuple, alone.collect())) and len(cut) == 3
