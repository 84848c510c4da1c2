from quantmill.llm import license_scan as s

from .helpers import EDGE_TEXTS, words


def test_automata():
    a = s.Automaton.compile("released under <<optional>>the terms of<<end>> the <<var:mit|x 11>> license <<any:2>> end")
    ok = lambda t: a.accept(s.split_words(t.encode()), 0) is not None
    assert ok("Released under the MIT license end") and ok("released under THE TERMS OF the x-11 license, one two end")
    assert not ok("released under terms of the mit license end") and not ok("released under the bsd license end") and not ok("released under the mit license one two three end")


def test_base_equals_brute_force(spark, data_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").limit(300).collect()}
    docs |= {-1 - i: t for i, t in enumerate(EDGE_TEXTS)}
    docs |= {-50: "Under the MIT license. CC-BY-NC cc by nc", -51: "under the mit licenses", -52: "Apache License, Version 2.0; apache license version 2"}
    got = {r.doc_id: r for r in s.scan_licenses(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    for i, t in docs.items():
        w = words(t)
        places = sorted((k, label) for p, label in s.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_method_adds_labels(spark):
    docs = [(1, "This work is licensed under the GNU General Public License, version 3."), (2, "licensed under the gnu public license version 3")]
    got = {r.doc_id: r.labels for r in s.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "gpl-3", 2: ""}
    assert s.scan_licenses(spark.createDataFrame([], "doc_id long, text string, labels string")).count() == 0


DISCLAIMED = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR'
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def test_whole_wording_is_needed(spark):
    grant = s._MIT_GRANT.replace("<<optional>>the software<<end>>", '(the "Software")').replace("<<var:the software|this software>>", "the Software")
    notice = s._MIT_NOTICE.replace("<<optional>>including the next paragraph<<end>>", "")
    bsd = s._BSD_GRANT.replace("<<optional>><<var:1|a>><<end>>", "1.").replace("<<optional>><<var:2|b>><<end>>", "2.")
    names = "3. Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    waiver = s._BSD_DISCLAIMER.replace("<<any:12>>", "the copyright holders and contributors").replace("<<any:14>>", "the copyright owner or contributors")
    docs = {
        1: f"{grant}, {notice}. {DISCLAIMED}", 2: f"{grant}. {DISCLAIMED}", 3: f"{grant}, {notice}. The Software shall be used for Good. {DISCLAIMED}", 4: grant, 5: f"{bsd} {waiver}", 6: f"{bsd} {names} {waiver}", 7: f"{bsd} {names}",
        8: "SPDX-License-Identifier: AGPL-3.0-or-later", 9: f"{grant}, {notice}. {DISCLAIMED.replace('TORT', 'CRIME')}", 10: f"x {bsd} {waiver} y {grant}. {DISCLAIMED}",
    }
    rows = [(i, t, "mit") for i, t in docs.items()] + [(1, docs[1], "mit")]
    got = sorted((r.doc_id, r.labels) for r in s.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect())
    assert got == [(1, "mit"), (1, "mit"), (2, "mit-0"), (3, ""), (4, ""), (5, "bsd-2"), (6, "bsd-3"), (7, ""), (8, "agpl-3"), (9, ""), (10, "bsd-2,mit-0")]


def test_base_places_equal_sql(spark, small_dir):
    from tests.compare import close, connect
    from tests.compare import rows as ordered

    df = s.base_places(spark.read.parquet(f"{small_dir}/documents.parquet"))
    found = connect(small_dir).execute(s.BASE_SQL)
    a, b = ordered(df.columns, df.collect()), ordered([c[0] for c in found.description], found.fetchall())
    assert len(a) == len(b) and all(close(x, y) for i, j in zip(a, b, strict=True) for x, y in zip(i, j, strict=True))
