"""Every stage of the pipeline against plain Python on the same rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from vellumspark.llm import line_dedup, quality
from test_quality_brute import brute
from tests_llm_brute import near

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near duplicates", "mixing", "packing"]

    def write(df, name, at=[0]):  # noqa: B006
        at[0] += 1
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{at[0]}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    docs = write(docs, "docs")
    good = write(stages["quality"](spark, docs, SF), "good")
    keep = {d for d, p in brute(docs.collect(), labels.collect()).items() if p >= quality.KEEP}
    assert good.columns == docs.columns and rows_of(good) == rows_of(docs.where(docs.doc_id.isin(list(keep))))

    lines = write(stages["lines"](spark, good, SF), "lines")
    pages, seen = Counter(r.source for r in good.collect()), Counter()
    for r in good.collect():
        seen.update({(r.source, x.strip(" \t\n\v\f\r")) for x in r.text.split("\n")})
    want = []
    for r in good.collect():
        left = [x for x in r.text.split("\n") if not x.strip() or (n := seen[r.source, x.strip(" \t\n\v\f\r")]) < line_dedup.MIN_PAGES or n <= line_dedup.RATIO * pages[r.source]]
        want.append((r.doc_id, "\n".join(left), r.lang, r.source, len("\n".join(left))))
    assert lines.columns == docs.columns and rows_of(lines) == sorted(want, key=repr)

    one = write(stages["near duplicates"](spark, lines, SF), "one")
    texts = {r.doc_id: r.text for r in lines.collect()}
    first = near(texts)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {d for d in texts if first[d] == d}

    mixed = write(stages["mixing"](spark, one, SF), "mixed")
    times = Counter(r.doc_id for r in mixed.collect())
    sizes, by = {r.doc_id: len(r.text.encode().split()) for r in one.collect()}, defaultdict(list)
    for r in one.collect():
        by[r.source].append(r.doc_id)
    total, w = sum(sizes.values()), {s: i % 3 + 1 for i, s in enumerate(sorted(by))}
    size = {s: sum(sizes[d] for d in by[s]) for s in by}
    full = set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(w[s] for s in by if s not in full)
        more = {s for s in by if s not in full and level * w[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    for s in by:
        target = 3 * size[s] if s in full else level * w[s]
        taken = sum(times[d] * sizes[d] for d in by[s])
        assert abs(taken - target) <= max(sizes[d] for d in by[s]) / 2 + 1e-6
        rounds = int(target // size[s])
        u = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) for d in by[s]}
        more = [u[d] for d in by[s] if times[d] == rounds + 1]
        assert all(times[d] in (rounds, rounds + 1) for d in by[s]) and all(u[d] > max(more, default=-1) for d in by[s] if times[d] == rounds)

    packed = [r for r in stages["packing"](spark, mixed, SF).collect()]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    seqs, pieces = defaultdict(list), defaultdict(Counter)
    for r in packed:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    for r in one.collect():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 1]
        assert sum(n * k[1] for k, n in pieces[r.doc_id].items()) == times[r.doc_id] * len(ids)
        for start, length, crc, all_ in pieces[r.doc_id]:
            assert all_ == len(ids) and crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + length]))


def test_run_gives_the_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
