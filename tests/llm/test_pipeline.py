"""Secret scans and the pipeline against plain Python."""

import hashlib
import re

import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import byte_bpe, decontaminate, secrets
from tests.llm.test_corpus import HARD, SF, brute_base, brute_keep_one, edit_distance_anywhere, hard


def brute_spans(text, model):
    base, found = brute_base(text), []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        at = [secrets.ALPHABET.index(c) for c in m[0]]
        mean = sum(float(f"{model[a * len(secrets.ALPHABET) + b]:.5f}") for a, b in zip(at, at[1:], strict=False)) / (len(at) - 1)
        if mean > secrets.MARGIN and not any(s < m.end() and m.start() < e for s, _, e in base):
            found.append((m.start(), 3, m.end()))
    return base, sorted(base + found)


def brute_redact(text, model):
    out, at = [], 0
    for start, kind, end in brute_spans(text, model)[1]:
        if start >= at:
            out += [text[at:start], f"[{secrets.KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_rows():
    rows = [tuple(r) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pandas().itertuples(index=False)]
    return [*rows, *HARD, *((10_000 + k, f"x{k} " + hashlib.sha256(bytes([k])).hexdigest().upper()[: 18 + k % 20] + " getUserNameForAccountKey token='" + "Ab1" * (k % 7) + "'") for k in range(60))]


def test_all_spans_equal_brute_force(spark):
    model, rows = secrets.train(secrets.samples(spark)), secret_rows()
    got = sorted((str(r.doc_id), [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in secrets.scan(hard(spark, rows), model).collect())
    assert got == sorted((str(i), *brute_spans(t or "", model)) for i, t in rows)
    assert any(s[1] == 3 for _, _, spans in got for s in spans)
    assert secrets.scan(hard(spark).limit(0), model).count() == 0


def say(seed, n):
    return " ".join(hashlib.sha256(f"{seed}/{k}".encode()).hexdigest()[:5].translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(n))


def brute_quality(rows):
    def fails(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words) < 10, 100 * len(covered) > 20 * len(words), 10 * len(re.findall(r"[#*$%&|<>]", text or "")) > len(words), 10 * (len(lines) - len(set(lines))) > 3 * len(lines)

    bad = set()
    for rule in range(4):
        hosts = {}
        for _, text, host in rows:
            if host:
                n, k = hosts.get(host, (0, 0))
                hosts[host] = n + 1, k + fails(text)[rule]
        total, failed = sum(n for n, _ in hosts.values()), sum(k for _, k in hosts.values())
        m = failed / total
        between = max((sum(k * k / n for n, k in hosts.values()) - total * m * m - (len(hosts) - 1) * m * (1 - m)) / total, 0)
        strength = min(max(m * (1 - m) / between - 1 if between > 0 else 1e6, 1), 1e6)
        bad |= {h for h, (n, k) in hosts.items() if (k + m * strength) / (n + strength) > 0.8}
    assert {"junk", "signs"} <= bad
    return [r for r in rows if not any(fails(r[1])[:2]) and r[2] not in bad]


def test_pipeline_equals_plain_python(spark, tmp_path):
    item = say("item", 30)
    rows = [(k, say(k, 30), f"h{k % 3}") for k in range(20)] + [(100 + k, say(k, 30) + " more", "h1") for k in range(0, 20, 2)]
    rows += [(200, f"before {item} after", "h0"), (201, say("x", 12) + " " + item.replace(item[50], "_", 1).upper(), None), (202, say("y", 20) + " password='Abcdefgh12345'", "h1"), (203, say("z", 30) * 2, "h2")]
    rows += [(300 + k, "too short", "junk") for k in range(60)] + [(400, say("good", 40), "junk"), (5, say("other", 25), "h0"), (5, say("other", 25), "h0"), (None, say("null", 25), ""), (None, say(3, 30), None)]
    rows += [(500 + k, say(f"sign{k}", 12) + " $$", "signs") for k in range(40)] + [(600, say("plain", 40), "signs")]
    rows += [(i, t, None) for i, t in HARD]
    spark.createDataFrame([(*r, 1, "c", "x") for r in rows], "doc_id long, text string, source string, n_chars long, _chosen string, lang string").coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, " ")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = brute_keep_one(brute_quality(rows), 5, 80)
    normal = decontaminate.normal(item)
    kept = [r for r in kept if edit_distance_anywhere(normal, decontaminate.normal(r[1])[:2000]) > len(normal) * 5 // 100]
    model = secrets.train(secrets.samples(spark))
    want = []
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for i, text, _ in kept:
        text = brute_redact(text, model)
        ids = exact.encode_ordinary(text)
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
    assert {"200", "201", "400", "300", "203", "500", "600"}.isdisjoint(w[0] for w in want) and len(want) > 20


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = hard(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        empty = stage(spark, docs.where(F.lit(False)), SF)
        assert empty.columns == docs.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where(F.lit(False)), SF).count() == 0
