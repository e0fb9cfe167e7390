import io
import json
import threading
import zipfile
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltra.config import Config
from siltra.operators import adapters as ad
from siltra.sources import files, records

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs, tables=()):
    p = lambda s, t: f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(s, t) for s, t in paragraphs)
    for rows in tables:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(None, c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def pdf(pages):
    """A PDF with one deflated stream a page; blocks are (x, y, lines)."""
    objs = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"]>>"}
    for i, blocks in enumerate(pages):
        s = b"".join(b"BT /F1 12 Tf %d %d Td " % (x, y) + b" 0 -14 Td ".join(b"(%s) Tj" % t for t in lines) + b" ET\n" for x, y, lines in blocks)
        z = zlib.compress(s)
        objs[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * i)
        objs[11 + 2 * i] = b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(z), z)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objs.items()) + b"trailer<</Root 1 0 R>>\n%%EOF"


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.TXT").write_bytes(b"  caf\xc3\xa9 \xff bytes \n")
    (tmp_path / "sub" / "b.txt").write_text("other")
    (tmp_path / "blank.md").write_text(" \n")
    (tmp_path / "skip.csv").write_text("no")
    (tmp_path / "d.docx").write_bytes(docx([(None, "lead"), ("H1", "Part"), (None, " "), (None, "body text")], [[["a", ""], ["", ""], ["b", "c"]]]))
    (tmp_path / "p.pdf").write_bytes(pdf([[(50, 600, [b"lower"]), (50, 700, [b"upper \\(x\\)", b"second"])], []]))
    return str(tmp_path)


def test_pages(spark, corpus):
    got = [(r.path.split(corpus)[1], r.source, r.page, r.text, r.suspect_scanned) for r in files.read_pages(spark, corpus).orderBy("path", "page").collect()]
    assert got == [
        ("/b.TXT", "b.TXT", 1, "  café  bytes \n", False), ("/blank.md", "blank.md", 1, " \n", False), ("/d.docx", "d.docx", 1, "lead\nPart\nbody text\na\nb | c", True),
        ("/p.pdf", "p.pdf", 1, "upper (x)\nsecond\nlower", True), ("/p.pdf", "p.pdf", 2, "", True), ("/sub/b.txt", "b.txt", 1, "other", False),
    ]


def test_units(spark, corpus):
    got = [(r.source, r.page, r.unit_no, r.kind, r.text) for r in files.read_units(spark, corpus).orderBy("path", "unit_no").collect()]
    assert got == [
        ("b.TXT", 1, 0, "file", "  café  bytes \n"), ("d.docx", 1, 0, "section", "lead"), ("d.docx", 1, 1, "section", "Part\nbody text"), ("d.docx", 1, 2, "table", "a\nb | c"),
        ("p.pdf", 1, 0, "block", "upper (x)\nsecond"), ("p.pdf", 1, 1, "block", "lower"), ("b.txt", 1, 0, "file", "other"),
    ]


def test_eval_set_and_spans(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"_note": "n", "questions": [{"q": "A?", "type": "factual", "expect": "1"}, {"q": "B?", "type": "multihop"}]}, indent=1))
    assert [tuple(r) for r in records.read_eval_set(spark, str(tmp_path / "e.json")).collect()] == [("A?", "factual", "1"), ("B?", "multihop", None)]
    log = tmp_path / "log"
    with pytest.raises(ValueError):
        records.read_spans(spark, str(tmp_path / "log"))
    with records.RunLog(spark, str(log), "naive", machine="m") as run:
        with run.timer("retrieve", k=5, n_candidates=1) as s:
            s["n_candidates"] = 20
        with pytest.raises(KeyError), run.timer("generate"):
            raise KeyError("gone")
        assert spark.read.text(run.path).count() == 3  # a failure is on disk at once
        run.note("answer", 0.0, i=0, sources=object())
        run.append(spark.createDataFrame([("answer", 0.0, 1, ["a p.1"], 1.5)], "stage string, ms double, i int, cited array<string>, own_field double"))
    (log / "0.jsonl").write_text('\n{"stage": "parse", "ms": 1.5, "config": "x"}\n\n')
    got = records.read_spans(spark, str(log))
    assert sorted(r.own_field for r in got.where("own_field is not null").collect()) == [1.5] and got.where("machine = 'm'").count() == 1  # the union of keys
    assert got.where("stage = 'run_start'").first().file.endswith(f"_naive_{run.run_id}.jsonl") and got.select("run_id").distinct().count() == 2
    by = {r.stage: r for r in got.where("i is null or i = 0").collect()}
    assert set(by) == {"run_start", "retrieve", "generate", "answer", "run_end", "parse"}
    assert (by["retrieve"].k, by["retrieve"].n_candidates) == (5, 20) and by["generate"].error == "KeyError: 'gone'" and by["parse"].file == "0.jsonl" and by["parse"].rss_mb is None
    assert by["run_start"].rss_mb > 0 and by["retrieve"].ms >= 0
    records.write_spans(got.select("stage", "ms"), str(tmp_path / "again"))
    assert spark.read.json(str(tmp_path / "again")).count() == 7
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "0.jsonl").write_text('{"stage": "parse"}\nno json\n')
    with pytest.raises(Exception):  # noqa: B017
        records.read_spans(spark, str(tmp_path / "bad")).count()
    records.write_results(got.select("stage").distinct().orderBy("stage"), str(tmp_path / "r.json"))
    assert [x["stage"] for x in json.loads((tmp_path / "r.json").read_text())] == sorted(by)


def test_hash_embedder_and_rerank(spark):
    v = ad.HashEmbedder(16).encode(["Alpha beta ALPHA", "", "beta alpha alpha"])
    assert np.allclose(v[0], v[2]) and np.isclose((v[0] ** 2).sum(), 1) and not v[1].any()
    df = ad.embed(spark.createDataFrame([(1, "a b"), (2, None)], "k long, text string"), ad.HashEmbedder)
    assert [len(r.embedding) for r in df.collect()] == [64, 64]
    pool = spark.createDataFrame([(1, 5, "rent of camp", "camp"), (1, 4, "rent of camp", "rent camp x"), (1, 3, "rent of camp", None), (1, 2, "rent of camp", "camp")], "query_id long, chunk_no long, question string, text string")
    assert [(r.chunk_no, r.rank) for r in ad.rerank(pool, 3).orderBy("rank").collect()] == [(4, 1), (2, 2), (5, 3)]
    with pytest.raises(ValueError):
        ad.generator("none")
    assert ad.embed(df.select("k", "text").where("false"), ad.HashEmbedder).count() == 0


@pytest.fixture
def server():
    seen = []

    class H(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            if self.path == "/api/chat":
                lines = [{"message": {"content": ""}}, {"message": {"content": "Hel"}}, {"message": {"content": "lo"}}, {"done": True}]
                out = b"\n".join(json.dumps(x).encode() for x in lines) + b"\n"
            elif self.path == "/api/embed":
                out = json.dumps({"embeddings": [[3.0, 4.0]] * len(body["input"])}).encode()
            elif body["max_tokens"] == 1:
                self.send_error(500)
                return
            else:
                lines = [{"choices": [{"delta": {"reasoning_content": "hm"}}]}, {"choices": [{"delta": {"content": "Hi"}}]}, {"choices": []}, {"choices": [{"delta": {}}], "timings": {"prompt_ms": 5.0, "predicted_per_second": 9.0}}]
                out = b"".join(b"data: " + json.dumps(x).encode() + b"\n\n" for x in lines) + b"data: [DONE]\n\n"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_generators(spark, server):
    url, seen = server
    df = spark.createDataFrame([(1, [("system", "s"), ("user", "u")])], "query_id long, messages array<struct<role:string,content:string>>")
    o = ad.generate(df, Config("x", ollama_host=url)).first()
    assert (o.answer, o.n_chunks_streamed, o.error, o.server_prompt_ms) == ("Hello", 2, None, None) and o.ttft_ms >= 0 and o.tok_per_s > 0
    assert seen[0][0] == "/api/chat" and seen[0][1]["keep_alive"] == "5m" and seen[0][1]["options"] == {"num_predict": 400} and seen[0][1]["messages"][1] == {"role": "user", "content": "u"}
    p = ad.generate(df, Config("x", gen_backend="llamacpp", llama_host=url), partitions=1).first()
    assert (p.answer, p.server_prompt_ms, p.server_predict_tok_per_s, p.server_predict_ms) == ("Hi", 5.0, 9.0, None)
    assert (p.n_reasoning, p.n_chunks_streamed) == (1, 1)
    turns = spark.range(6).selectExpr("id as turn").crossJoin(df.select("messages"))
    fired = ad.burst(turns, Config("x", gen_backend="llamacpp", llama_host=url), 4).collect()
    assert sorted(r.turn for r in fired) == [0, 1, 2, 3] and all((r.level, r.n_content, r.n_reasoning, r.error) == (4, 1, 1, None) and r.wall_s > 0 for r in fired)
    bad = ad.generate(df, Config("x", gen_backend="llamacpp", llama_host=url, max_tokens=1)).first()
    assert bad.answer is None and bad.error.startswith("HTTPError")
    v = ad.OllamaEmbedder(Config("x", ollama_host=url, embed_batch=2)).encode(["a", "b", "c"])
    assert np.allclose(v, [[0.6, 0.8]] * 3)
    assert ad.generate(df.where("false"), Config("x", gen_backend="extractive")).count() == 0
    assert df.select(F.size("messages")).first()[0] == 2
