"""Anchor files, URIs, JSON with comments, heads and pointers."""

import json

import pytest
from pyspark.sql import functions as F

from lodestream.operators import anchors

JSONC = [
    ('{"a": 1}', {"a": 1}),
    ('{"a": 1, // end\n}', {"a": 1}),
    ('{/* x */"a": [1, 2,], "b": {"c": 3,\n\t},}', {"a": [1, 2], "b": {"c": 3}}),
    ('{"a": "// no", "b": "/* no */", "c": ",]"}', {"a": "// no", "b": "/* no */", "c": ",]"}),
    (r'{"a": "q\" // no", "b\\": ",}"} // "', {"a": 'q" // no', "b\\": ",}"}),
    ('[1, /* , */ 2 /* ] */ , // x\n ]', [1, 2]),
    ('{"a": 1} /* open', {"a": 1}),
    ("{}", {}),
    ('{"long": "' + "x" * 50_000 + '", }', {"long": "x" * 50_000}),
]


def test_comments_and_trailing_commas(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(JSONC)], "k int, t string")
    got = {r["k"]: json.loads(r["j"]) for r in df.select("k", anchors.json_of(F.col("t")).alias("j")).collect()}
    assert got == {k: v for k, (_, v) in enumerate(JSONC)}


@pytest.mark.parametrize(
    ("uri", "path"),
    [
        ("file:///home/u/a%20b", "/home/u/a b"), ("file:///c%3A/Users/x", "c:/Users/x"), ("file:///C:/x", "C:/x"), ("file://localhost/x", "/x"), ("file://host/x", None), ("FILE:///x", "/x"),
        ("vscode-remote://wsl/x", None), ("/x", None), ("file://", None), ("", None), (None, None), ("file:///a+b%2Bc", "/a+b+c"), ("file:///a%zz", None), ("file:///x?q#f", "/x"), ("file:///d%C3%A9j%C3%A0", "/déjà"),
    ],
)
def test_local_paths(spark, uri, path):
    df = spark.createDataFrame([(uri,)], "u string")
    assert df.select(anchors.local_path(F.col("u"))).first()[0] == path


def test_workspaces_of_one_and_of_several_folders(spark):
    own = spark.createDataFrame(
        [("/s/1", '{"folder":"file:///a/b/../c"}'), ("/s/2", '{"workspace":"file:///w/x.code-workspace"}'), ("/s/3", '{"folder":"ssh://h/x","workspace":"file:///w/x.code-workspace"}'), ("/s/4", "torn {"), ("/s/5", '{"workspace":"file:///none"}'), ("/s/6", '{"workspace":"file:///w/bad"}'), ("/s/7", '{"folder":7}'), ("/s/8", None)],
        "dir string, content string",
    )
    files = spark.createDataFrame([("/w/x.code-workspace", '{"folders":[{"path":"."},{"path":"/abs/y"},{"uri":"file:///u%20z"},{"uri":"ssh://h/q"},{"path":""},{"path":"c:\\\\v"},],}'), ("/w/bad", '{"folders": 3}')], "path string, content string")
    got = sorted(map(tuple, anchors.opened(own, files).collect()))
    assert got == [("/s/1", "/a/c"), ("/s/2", "/abs/y"), ("/s/2", "/u z"), ("/s/2", "/w"), ("/s/2", "c:/v")]
    rels = [("a", "vs", "2/f.json"), ("b", "vs", "1/deep/f"), ("c", "vs", "2"), ("d", "vs", "../f"), ("e", "no", "2/f"), ("f", "cli", "1/x/f"), ("g", "vs", "1\\f")]
    placed = anchors.anchored(spark.createDataFrame([(k, s, "/s", r) for k, s, r in rels], "key string, source_id string, root string, rel string"), {"vs": 1, "cli": 2}, anchors.opened(own, files))
    assert sorted(map(tuple, placed.collect())) == [("a", "/abs/y"), ("a", "/u z"), ("a", "/w"), ("a", "c:/v"), ("b", "/a/c"), ("g", "/a/c")]
    assert sorted(map(tuple, anchors.single(placed).collect())) == [("b", "/a/c"), ("g", "/a/c")]


def test_session_starts_and_heads(spark):
    own = spark.createDataFrame([("/1", '{"cwd":"/x/"}\n{"cwd":"/y"}'), ("/2", '{"cwd":"/x"}'), ("/3", '{"data":{"cwd":"/z"}}\n'), ("/4", 'torn\n{"cwd":"/y"}\n'), ("/5", '{"cwd":5}\n'), ("/6", '{"cwd":"/"}\n')], "dir string, content string")
    assert sorted(map(tuple, anchors.started(own, ["cwd", "data.cwd"]).collect())) == [("/1", "/x"), ("/3", "/z")]
    far = "é" * (anchors.HEAD_BYTES // 2)
    heads = spark.createDataFrame([("a", 'torn\n\n{"n":1}\n{"p":{"cwd":"/q"}}\n{"cwd":"/r"}'), ("b", far + '\n{"cwd":"/r"}'), ("c", ""), ("d", None), ("e", '{"cwd":null,"p":{"cwd":"/s/./t"}}'), ("f", '{"p":"x"}')], "path string, content string")
    assert {r["path"]: r["cwd"] for r in anchors.probed(heads, ["cwd", "p.cwd"]).collect()} == {"a": "/q", "b": None, "c": None, "d": None, "e": "/s/t", "f": None}


def test_pointers_are_followed_to_their_ends(spark):
    leads = [("/a", "/b"), ("/b", "/c"), ("/x", "/y"), ("/y", "/x"), ("/self", "/self"), ("/nowhere", None), *((f"/{k}", f"/{k + 1}") for k in range(9))]
    starts = [("two", "/a"), ("one", "/b"), ("none", "/c"), ("circle", "/x"), ("self", "/self"), ("nowhere", "/nowhere"), ("long", "/0"), ("just", "/5"), ("again", "/a")]
    got = anchors.followed(spark.createDataFrame(starts, "key string, at string"), spark.createDataFrame(leads, "at string, to string"))
    assert {r["key"]: r["end"] for r in got.collect()} == {"two": "/c", "one": "/c", "none": "/c", "circle": None, "self": None, "nowhere": None, "long": None, "just": "/9", "again": "/c"}


def test_checkouts_above_a_folder(spark):
    cwds = spark.createDataFrame([("in", "/h/u/p/src/x"), ("at", "/h/u/p"), ("tree", "/h/u/w/x"), ("bare", "/h/u/b"), ("bad", "/h/u/p/bad/x"), ("home", "/h/u/q"), ("out", "/opt/o/x"), ("rel", "p/x"), ("drive", "c:/x")], "key string, cwd string")
    entries = spark.createDataFrame([("/h/u/p", None), ("/h/u/w", "gitdir: ../p/.git/worktrees/w\n"), ("/h/u/b", "gitdir: /srv/b.git/worktrees/b"), ("/h/u/p/bad", "not a pointer"), ("/h/u", None), ("/opt/o", None)], "dir string, content string")
    commons = spark.createDataFrame([("/h/u/p/.git/worktrees/w", "../..\n"), ("/srv/b.git/worktrees/b", "../.."), ("/unused", "")], "dir string, content string")
    got = {r["key"]: (r["root"], r["common"], r["main"]) for r in anchors.checkouts(cwds, entries, commons, ceiling="/h/u").collect()}
    none = (None, None, None)
    plain = ("/h/u/p", "/h/u/p/.git", "/h/u/p")
    assert got == {"in": plain, "at": plain, "tree": ("/h/u/w", "/h/u/p/.git", "/h/u/p"), "bare": ("/h/u/b", "/srv/b.git", None), "bad": none, "home": none, "out": ("/opt/o", "/opt/o/.git", "/opt/o"), "rel": none, "drive": none}
