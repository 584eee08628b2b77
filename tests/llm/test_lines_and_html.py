import time
from collections import defaultdict
from html.parser import HTMLParser

import duckdb
import pytest
from cueline.llm import html_text as H
from cueline.llm import line_dedup as D
from rows import clashing, table


def brute(rows, min_sites, min_words):
    norm = lambda x: x.strip(" \t\r")
    long = lambda x: norm(x) != "" and len(norm(x).split(" ")) >= min_words
    sites = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if long(x) and r[3] is not None:
                sites[norm(x)].add(r[3])
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (long(x) and norm(x) in bad)]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("min_sites", [2, 5, 60])
def test_lines_against_brute_force(spark, min_sites):
    rows = []
    for i in range(240):
        lines = [f"own line of {i}", "two words", "", f"shared by {i % 3} of three", f" wide line {i % 40}\t", "everywhere on the web\r"]
        rows.append((i if i % 50 else None, "\n".join(lines[i % 4 :]) if i % 17 else None, "en", f"site{i % 97}" if i % 11 else None, 0))
    rows.append(rows[1])
    got = D.remove_boilerplate(clashing(table(spark, rows)), min_sites=min_sites).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, min_sites, 3), key=key)


def test_lines_oracle_and_empty(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = D.remove_boilerplate(spark.read.parquet(f"{sf}/documents.parquet"), min_sites=3).collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(D.oracle(min_sites=3)).fetchall())
    assert D.remove_boilerplate(table(spark, [])).collect() == []


def test_lines_without_spaces_are_judged(spark):
    shared = ["版权所有未经许可不得转载", "ログインしてください", "สงวนลิขสิทธิ์ทุกประการ", "Home\tAbout\tContact", "all\u3000rights\u3000reserved"]
    rows = [(i, "\n".join([*shared, "Log in", "登录", f"only here {i}"]), "en", f"site{i}", 0) for i in range(8)]
    for r in D.remove_boilerplate(table(spark, rows)).collect():
        assert (r.n_removed, r.text) == (5, f"Log in\n登录\nonly here {r.doc_id}")


CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; text", "plain & text"),
    ("<p>one<p>two</p>three", "one\n\ntwo\n\nthree"),
    ("<div>a</div><div>b <b>c</b>d</div>", "a\nb cd"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=3><li>a</li><li>b</ol>", "3. a\n4. b"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td colspan=2>whole row</table>", "name       n\nlong name  1\nwhole row"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("x<script>var t='</p>';if(a<b){}</script>y<style>p{}</style>z", "xyz"),
    ("<head><title>t</title></head><body>seen<span style='display:none'>no</span><i hidden>no</i></body>", "seen"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("a<!-- no <p> -->b<!doctype html>c", "abc"),
    ("<dl><dt>t<dd>d1<dt>u<dd>d2</dl>", "t\nd1\nu\nd2"),
    ("a < b and <p title='x>y'>c", "a < b and\n\nc"),
    ("<p>open <b>never closed", "open never closed"),
    ("</p></div>stray", "stray"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<a href=\"unclosed>x</a> y", "x y"),
    ("a&nbsp;b  \n c", "a\xa0b c"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\nin"),
    ("<table><tr><td><p>First</p><p>Second</p><ul><li>one<li>two</ul></table>", "First\nSecond\n- one\n- two"),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td>x<td><table><tr><td>1<td>2<tr><td>3<td>4</table></table>", "x  1  2\n   3  4"),
    ("<table><tr><th>Price<br>(USD)<th>Name<tr><td>1<td>long name<td>z</table>", "Price  Name\n(USD)\n1      long name  z"),
    ("<table><tr><td>nav<td>" + "long " * 30 + "<tr><td>a<td>b</table>", "nav\n" + ("long " * 30).strip() + "\na  b"),
    ("a<!-- no end <b>x", "a"),
    ("a<b class='no end", "a"),
    ("1 <2 <3", "1 <2 <3"),
    ("<input type=hidden value=x>after<template>no</template>", "after"),
    ("<body>" + "<div>" * 5000 + "deep", "deep"),
]


HOSTILE = ["<a ", "<a \"", "<a \"'", "<div>", "<p><table><div>", "</x><div>", "<ul><li>x", "<svg><g/>", "< ", "<tr><td>a<td colspan=100>b", "<tr><td rowspan=100>a", "<li>", "<a '>\"<a \">'", "<!", "<script>"]


@pytest.mark.parametrize("part", HOSTILE)
def test_time_and_text_follow_the_page(part):
    def took(n):
        began = time.thread_time()
        text = H.page_text("<table>" * (part[:3] == "<tr") + part * n)
        return time.thread_time() - began, len(text)

    (few, _), (many, size) = took(40_000 // len(part)), took(320_000 // len(part))
    assert many < 24 * few + 0.5 and size < 60 * 320_000


@pytest.mark.parametrize("page,want", CASES)
def test_layout(page, want):
    assert H.page_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("so <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> holds", "so x=2 holds"),
        ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><defs/><path d='M0'/><text>one</text><text>two</text></svg>", "one\ntwo"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
        ("<ul><li style='visibility:hidden'>no<li>b</ul>", "- b"),
        ("<i style='backface-visibility:hidden'>yes</i><p><desc>out</desc>", "yes\n\nout"),
    ],
)
def test_svg_math_and_inherited_visibility(page, want):
    assert H.page_text(page) == want


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def test_all_visible_words_of_the_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = H.extract(clashing(pages)).collect()
    assert len(got) == len(html)
    for r in got:
        p = Plain()
        p.feed(html[r.page_id])
        mine = r.text.split()
        assert [w for w in mine if w != "-" and not w[:-1].isdigit()] == [w for w in p.words if w != "-" and not w[:-1].isdigit()]


def test_pages_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "<p>x"), (2, ""), (2, "")], "page_id long, html string")
    assert sorted(map(tuple, H.extract(df).collect()), key=str) == sorted([(1, "", 0), (None, "x", 1), (2, "", 0), (2, "", 0)], key=str)
    assert H.extract(df.limit(0)).collect() == []
