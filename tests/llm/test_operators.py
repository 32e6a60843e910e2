"""The training-data operators against brute force, round trips, SQL and held-out labels."""

import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from oracle import assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from terrakin.llm import arrays, bpe, chat, ctw, globs, mixing, ogg, pretoken, queries, simhash, tokenfile, topk, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, key string, row long, n long, fp long, train boolean, domain string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    texts = [None, "", " \t\n", "a", "Same words here.", "Same words here.", "same words HERE.", long, long + "x", "é\u3000中文 \x85 <|endoftext|> 'tis don't", "tab\tx  y\n\n z"]
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, 7, "t", "k", 1, 1, 1, True, "d") for k, t in enumerate(texts)]
    rows += [rows[4], (None, "null id", None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, sf=SF):
    return queries.table(spark, sf, "documents")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).join(queries.table(spark, sf, "labels").filter("toxic is not null"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93
    hot, cold = held[held.toxic == 1], held[held.toxic == 0]
    assert hot.predicted.mean() > 0.5 and cold.predicted.mean() < 0.02
    assert np.mean([(cold.score < s).mean() for s in hot.score]) > 0.85
    assert got.score.between(0, 1).all()


def test_toxicity_learns_whole_texts_and_every_passage(spark):
    rng = random.Random(3)
    calm = [f"calm{k} river{k % 7}" for k in range(400)]
    insults = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(6)) for _ in range(120)]
    body = lambda: " ".join(rng.choices(calm, k=1_800))  # noqa: E731 - about 25,000 characters
    rows = [(k, f"{body()} {' '.join(insults[(k * 31 + j) % 120] for j in range(30))}", 1) for k in range(200)] + [(1_000 + k, body(), 0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    assert all(x.encode() in model.toxic for x in insults) and len(model.toxic) > 4_096
    assert model.score(" ".join(calm[:50]) + " " + " ".join(insults[:30])) > 0.5 > model.score(" ".join(calm[:50]))


def test_toxicity_scores_by_hand():
    """Two dictionaries, windows of eight words, and a logistic curve of what they save."""
    import zstandard

    rng = random.Random(2)
    calm = [f"calm{k}" for k in range(200)]
    body = lambda n: " ".join(rng.choices(calm, k=n))
    model = toxicity.train([body(90) + " swamp rat swine " + body(40) for _ in range(60)] + [body(130) for _ in range(120)], [1] * 60 + [0] * 120)
    assert all(w in model.toxic for w in (b" swamp", b" rat", b" swine")) and model.toxic.endswith(model.plain) and b"swine" not in model.plain
    how = zstandard.ZstdCompressionParameters.from_level(9, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_dict_id=0, write_checksum=0)
    packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for d in (model.plain, model.toxic)]
    for text in (body(70) + " You swamp RAT", "swamp", body(9), "x" * 3_000, "\u00dc Swine"):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
        cut = [b" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
        cut = [w[k : k + 1024] for w in cut for k in range(0, len(w), 1024)]
        saved = [len(packers[0].compress(w)) - len(packers[1].compress(w)) for w in cut]
        n = len(saved)
        x = [math.log(sum(math.exp(min(v, 40) / 2) for v in saved) / n), max(saved), math.log1p(sum(max(v - 3, 0) for v in saved)), sum(saved) / n, sum(v >= 2 for v in saved) / n]
        z = model.curve[0] + sum(a * b for a, b in zip(model.curve[1:], x))
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert model.score(None) == model.score("") == 1 / (1 + math.exp(-model.curve[0]))


def test_toxicity_edges(spark, odd, empty):
    model = toxicity.train(["you foul swamp rat, be gone " * 3] * 80 + ["the quiet river runs to the sea " * 3] * 80, [1] * 80 + [0] * 80)
    got = toxicity.scored(odd, model)
    assert got.count() == odd.count() and got.filter("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.scored(empty, model).isEmpty()
    assert toxicity.rejected(odd, model).columns == odd.columns
    assert model.score("a foul swamp rat " * 5) > model.score("a quiet river " * 5)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd, labels).score("x") < 1e-9


def test_mixing_edges(spark, odd, empty):
    got = mixing.selection(odd, mixing.Targets(max_epochs=2, budget_permille=1500), F.lit("d")).toPandas()
    assert len(got) == odd.count()
    assert got.taken_tokens.sum() == got.n_tokens.sum() * 3 // 2
    assert mixing.selection(empty, mixing.Targets(), F.lit("d")).isEmpty()
    assert mixing.mixed(odd, mixing.Targets(floor_epochs=1), F.lit("d")).columns == odd.columns


def test_mixing_salted_equals_broadcast(spark, monkeypatch):
    want = {tuple(r) for r in queries.op2_source_mixing(spark, SF).collect()}
    monkeypatch.setattr(mixing, "FEW_LEAVES", 0)
    assert {tuple(r) for r in queries.op2_source_mixing(spark, SF).collect()} == want


def test_mixing_gives_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s", 10), ("a", "y", "s", 1000), ("b", "x", "s", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r["domain"], r["lang"]): r["budget"] for r in mixing.allocate(leaves, mixing.Targets(max_epochs=1, budget_permille=500)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 492, ("b", "x"): 503} or sum(got.values()) == 1005 and got["a", "x"] == 10 and abs(got["b", "x"] - 502) <= 1


def test_mixing_floors_count_towards_the_targets(spark):
    leaves = spark.createDataFrame([("a", "x", "s", 700), ("a", "x", "t", 100), ("b", "x", "s", 200)], "domain string, lang string, source string, tokens long")
    targets = mixing.Targets(max_epochs=8, budget_permille=1000, floor_epochs=1)
    got = {(r["domain"], r["source"]): r["budget"] + r["tokens"] for r in mixing.allocate(leaves, targets).collect()}
    assert sum(got.values()) == 2000  # floor and budget; half to each domain, and in a half to each source
    assert abs(got["b", "s"] - 1000) <= 2 and abs(got["a", "s"] - 700) <= 2 and abs(got["a", "t"] - 300) <= 4


def test_mixing_cuts_the_last_document_at_a_token(spark):
    texts = [f" w{k}a  w{k}b\tw{k}c\nw{k}d " for k in range(40)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(90, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed(df, mixing.Targets(budget_permille=593), F.lit("d"), length_col="n_chars").collect()
    assert sum(len((r["text"] or "").split()) for r in got) == 160 * 593 // 1000
    odd = [r for r in got if r["doc_id"] < 90 and r["text"] != texts[r["doc_id"]]]
    assert len(odd) == 1 and texts[odd[0]["doc_id"]].startswith(odd[0]["text"]) and odd[0]["n_chars"] == len(odd[0]["text"])


def test_mixing_of_rows_that_share_an_id(spark):
    rows = [(None if k % 2 else 7, f"t{k} " * (1 + k % 5), "en", "s") for k in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.selection(df, mixing.Targets(budget_permille=500), F.lit("d")).toPandas()
    assert len(got) == 10_000 and got.taken_tokens.sum() == got.n_tokens.sum() // 2
    assert ((got.prefix_tokens > 0) & (got.prefix_tokens < got.n_tokens)).sum() <= 1


def test_token_files(spark, odd, empty, tokenizer):
    manifest = tokenfile.write(odd, queries.vocabulary(), shard_tokens=1000)
    got = tokenfile.read(manifest).orderBy("start").collect()
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for g, (name, text) in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (g["id"], g["start"], g["n_tokens"], g["ids_crc32"], bytes(g["ids"])) == (name, at, len(ids), zlib.crc32(raw), raw)
        at += len(ids)
    assert manifest.count() > 1
    assert tokenfile.read(tokenfile.write(empty, queries.vocabulary())).isEmpty()


def test_token_codes_of_every_width():
    ids = np.array([0, 5, 5, 5, *range(70_000)], "<u4")
    names, counts, back = tokenfile.unpack(tokenfile.pack([None, 3], [ids.tobytes(), b""]))
    assert names == [None, 3] and counts.tolist() == [len(ids), 0] and (back == ids).all()
    with pytest.raises(ValueError):
        tokenfile.unpack(b"not a shard")


def test_top_k_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(7)]) for k in range(300)]
    rows += [(300, None), (301, [None] + [0.1] * 6), (302, [float("nan")] * 7), (None, [1.0] * 7), (350, [0.5, 0.5]), (7, rows[7][1]), (50, rows[9][1])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, id string")
    sound = []
    for k, v in rows:
        if k is not None and v and all(x is not None and math.isfinite(x) for x in v):
            sound.append((k, [math.floor(256 * float(np.float32(x))) for x in v]))
    want = []
    for q in {k for k, _ in sound if k % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(own, v)), k) for name, own in sound if name == q for k, v in sound if k != q)[:5]
        want += [(q, r + 1, k, -x) for r, (x, k) in enumerate(s)]
    got = topk.search(df.drop("id"), F.col("id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    clash = topk.search(df.withColumns({"v": F.lit(1), "copy": F.lit(2), "qb": F.lit(3)}), F.col("id") % 50 == 0)
    assert sorted(map(tuple, clash.collect())) == sorted(want)
    assert topk.search(df.drop("id").limit(0), F.col("id") % 50 == 0).isEmpty()
    with pytest.raises(Exception, match="2\\*\\*63"):
        topk.search(df.select("vec_id", F.transform("embedding", lambda x: x * F.lit(1e9)).alias("embedding")), F.col("id") % 50 == 0).collect()


def test_top_k_of_repeated_ids_equals_the_sql(spark, tmp_path):
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.25]), (1, [0.75, -0.5]), (2, [0.25, 1.0]), (0, [-1.0, 0.25])] + [(3, [0.5, 0.5])] * 9
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/e")
    spark.read.parquet(f"{tmp_path}/e").toPandas().to_parquet(f"{tmp_path}/embeddings.parquet")
    assert assert_same(queries.op4_exact_top_k(spark, str(tmp_path)), queries.ORACLE_SQL["op4_exact_top_k"], str(tmp_path)) == 5


def test_chat_grammar(spark):
    nasty = ["<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|x", "plain", "", None, "a\nb", "<|nl|>", "😀 <|im_end|>"]
    rows = [(c, t, r, x, 1) for c, r in enumerate(["user", "assistant", None, "od\nd", "<|nl|>"]) for t, x in enumerate(nasty)]
    rows += [(None, None, None, None, 1), (9, 0, "assistant", "same", 1), (9, 0, "assistant", "same", 1)]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))
    for r in out.collect():
        want = [(a or "", b or "") for c, _, a, b, _ in rows if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        at, learned = 0, []
        for run in r["loss_mask"]:
            at += run["skip"]
            learned.append(r["formatted"][at : at + run["learn"]])
            at += run["learn"]
        assert at == len(r["formatted"])
        text = "".join(learned)
        assert (re.sub(r"<\\(\\*)\|", r"<\1|", text) if r["escaped"] else text) == "".join(b for a, b in want if a == "assistant")


def test_ogg_round_trip_and_damage(spark, odd, empty):
    got = ogg.digests(ogg.from_media(ogg.to_media(odd))).collect()
    texts = Counter(hashlib.sha256(raw + bytes(-len(raw) % 64 if raw else 64)).hexdigest() for raw in ((r["text"] or "").encode() for r in odd.collect()))
    assert Counter(r["payload_sha256"] for r in got) == texts
    assert ogg.to_media(empty).isEmpty()
    media = ogg.pack(bytes(range(256)) * 40, 10_000)
    assert ogg.unpack(media)[0] == bytes(range(256)) * 40
    for bad in (media[:-1], media[:300] + b"\0" + media[301:], media[1:], media[: len(media) // 2]):
        with pytest.raises(ogg.OggError):
            ogg.unpack(bad)


def plain_ogg(data):
    """Packets by stream of an Ogg file, read page by page with a bit-by-bit checksum."""
    streams, open_, at = {}, {}, 0
    while at < len(data):
        assert data[at : at + 5] == b"OggS\0"
        serial, lacing = data[at + 14 : at + 18], data[at + 27 : at + 27 + data[at + 26]]
        end = at + 27 + len(lacing) + sum(lacing)
        crc = 0
        for byte in data[at : at + 22] + bytes(4) + data[at + 26 : end]:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        assert crc == struct.unpack_from("<I", data, at + 22)[0]
        body = at + 27 + len(lacing)
        for size in lacing:
            open_[serial] = open_.get(serial, b"") + data[body : body + size]
            body += size
            if size < 255:
                streams.setdefault(serial, []).append(open_.pop(serial))
        at = end
    return streams


def test_ogg_digests_by_an_independent_reader(spark):
    rows = docs(spark).filter("length(text) < 900 or text is null").select("doc_id", "text")
    media = {r["id"]: bytes(r["media"]) for r in ogg.to_media(rows).collect()}
    got = {r["id"]: r for r in ogg.digests(ogg.from_media(ogg.to_media(rows))).collect()}
    assert len(got) == rows.count() > 20
    for r in rows.collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        streams = {p[0][:8]: p[1:] for p in plain_ogg(media[r["doc_id"]]).values()}
        assert b"".join(streams[b"PCM     "]) == payload
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (g["media_bytes"], g["media_sha256"]) == (len(media[r["doc_id"]]), hashlib.sha256(media[r["doc_id"]]).hexdigest())
        f = json.loads(g["feature"])
        assert (f["ms"], f["sum"], f["peak"], f["streams"]) == (len(payload) * 1000 // ogg.RATE, sum(payload), max(payload), 2)


def test_ogg_of_nulls_and_nothing(spark):
    stored = spark.createDataFrame([(1, None), (2, ogg.pack(bytes(64), 0))], "id long, media binary")
    got = {r["id"]: r for r in ogg.from_media(stored).collect()}
    assert got[1]["payload"] is None and got[1]["n_bytes"] is None and got[2]["n_bytes"] == 0
    assert ogg.from_media(stored.limit(0)).isEmpty()


def test_ogg_checks_and_times_every_page():
    payload = bytes(k * 7 % 256 for k in range(300_032))
    media = ogg.pack(payload, 300_000)
    pages, at = [], 0  # of the sample stream: (start, end, granule)
    while at < len(media):
        n = media[at + 26]
        end = at + 27 + n + sum(media[at + 27 : at + 27 + n])
        if struct.unpack_from("<I", media, at + 14)[0] == zlib.crc32(payload):
            pages.append((at, end, struct.unpack_from("<q", media, at + 6)[0]))
        at = end
    feature = json.loads(ogg.unpack(media)[3])
    assert len(pages) > 4 and feature["page_ms"] == [g * 1000 // ogg.RATE for _, _, g in pages[1:]]
    for a, b, granule in pages[1:]:
        for wrong in (granule - 1, granule + ogg.PACKET, -1):
            page = media[a : a + 6] + struct.pack("<q", wrong) + media[a + 14 : a + 22] + bytes(4) + media[a + 26 : b]
            page = page[:22] + struct.pack("<I", ogg.checksum(page)) + page[26:]
            with pytest.raises(ogg.OggError):
                ogg.unpack(media[:a] + page + media[b:])


def test_chat_edges(spark):
    kind = "conv_id long, turn long, role string, text string, source string, loss_mask string"
    long = "word <|im_end|> " * 60_000
    rows = [(1, 0, "assistant", long, "s", "m"), (None, 1, "assistant", "b", "s", "m"), (None, 0, "user", "a", "s", "m"), (2, None, None, None, None, None)]
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(spark.createDataFrame(rows, kind))).collect()}
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert got[None]["n_turns"] == 2 and got[None]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[2]["loss_chars"] == 0
    none = chat.formatted(spark.createDataFrame([], kind))
    assert none.isEmpty() and chat.digests(none).isEmpty()


def test_chat_loss_is_cut_by_the_mask(spark):
    rows = [(1, 0, "user", "hi \u00e9"), (1, 1, "assistant", "d\u00e9j\u00e0 <|im_end|> vu"), (1, 2, "assistant", "more"), (2, 0, "assistant", "plain"), (2, 1, "assistant", "")]
    chats = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    for k, text in ((1, "d\u00e9j\u00e0 <|im_end|> vumore"), (2, "plain")):
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    moved = F.transform("loss_mask", lambda m: F.struct((m["skip"] + 1).alias("skip"), m["learn"].alias("learn")))
    for r in chat.digests(chats.withColumn("loss_mask", moved)).collect():
        assert r["loss_sha256"] != got[r["conv_id"]]["loss_sha256"]


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.LOWER))
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints, tau):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    names = sorted(root)
    for k, a in enumerate(names):
        for b in names[:k]:
            if (a ^ b).bit_count() <= tau:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in names}


def test_simhash_by_brute_force(spark):
    rows = docs(spark).select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_print(r["text"]) for r in rows}
    groups = brute_groups(set(prints.values()), 2)
    least = {}
    for d, p in prints.items():
        least[groups[p]] = min(d, least.get(groups[p], d))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_near_dedup(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", least[groups[p]]) for d, p in prints.items()}


@pytest.mark.parametrize("tau, bucket", [(2, simhash.BUCKET), (2, 2), (1, 2)])
def test_links_reach_what_brute_force_reaches(spark, tau, bucket):
    rng = random.Random(tau)
    bases = [rng.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in bases for _ in range(80)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = brute = None
    from terrakin.operators.components import components

    roots = {r["node"]: r["root"] for r in components(simhash.links(df, tau, bucket=bucket), "a", "b").collect()}
    unsigned = lambda p: p % (1 << 64)
    got, brute = {}, {}
    for p in signed:
        got.setdefault(roots.get(p, p), set()).add(unsigned(p))
    for p, r in brute_groups(prints, tau).items():
        brute.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, brute.values()))


def test_simhash_edges(spark, odd, empty):
    got = simhash.near_groups(odd).collect()
    assert len(got) == odd.count()
    same = {r["id"]: r["component"] for r in got}
    assert same[4] == same[5] == same[6] == 4 and same[0] == same[1] == same[2] == 0
    assert simhash.near_groups(empty).isEmpty()
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (5, 6)").isEmpty() and kept.filter("doc_id = 4").count() == 1


def brute_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.LOWER))
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_drops_edited_copies(spark):
    """Copies with edits that leave five-word similarity over or under 0.8, and a large group."""
    rng = random.Random(5)
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((base, " ".join(words)))
        for k, edits in enumerate((1, 3, 4, 9)):
            new = words[:]
            for e in range(edits):
                new[20 * e + 10] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * (k + 1) + base, " ".join(new)))
    common = [f"c{k}" for k in range(200)]
    for k in range(90):
        new = common[:]
        new[10 + 2 * k] = f"y{k}"
        rows.append((9000 + k, " ".join(new)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r[0] for r in stage(spark, df, SF).select("doc_id").collect()}
    assert kept == {*range(40), *range(4000, 4040), 9000}


def test_pipeline_keeps_no_two_texts_alike(spark, odd, empty):
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = [brute_set(r["text"]) for r in stage(spark, docs(spark), SF).collect()]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for k, a in enumerate(kept) for b in kept[:k] if a or b)
    gone = stage(spark, odd, SF)
    assert gone.columns == odd.columns and gone.filter("doc_id = 4").count() == 1 and gone.filter("doc_id in (1, 2, 5, 6, 8)").isEmpty()
    assert stage(spark, empty, SF).isEmpty()


@pytest.mark.parametrize("met", [simhash.MET, 16])
def test_large_buckets_lose_no_link(spark, monkeypatch, met):
    """Texts of one core that are alike only through one text, which few buckets have as a hub."""
    monkeypatch.setattr(simhash, "MET", met)
    core = [f"c{k}" for k in range(104)]
    rows = [(k, " ".join(core + [f"t{k}.{w}" for w in range(20 if k < 300 else 45)])) for k in range(310)]
    rows += [(310, " ".join([*core, "z"]))]
    kept = {r[0] for r in simhash.unlike(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == {0, *range(300, 310)}


def test_bands_reach_similar_sets():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        met += bool((simhash.bands(pool[:90]) == simhash.bands(pool[10:])).any())
    assert met == 200 and not len(simhash.bands(pool[:0]))


def test_globs_by_regular_expressions():
    def pattern(g):
        return re.compile("".join({"**": "[\\s\\S]*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p[-1]) for p in re.findall(r"\*\*|\*|\?|\\.|.", g)))

    rules = [*globs.BLOCK_GLOBS, "a?c/**/x*y", "long" * 40 + "/**", "**", "\\*lit\\?"]
    machine = globs.Automaton(rules)
    rng = random.Random(3)
    urls = ["".join(rng.choice(["a", "b", "c", "/", "x", "y", ".", "ads", "login", "*lit?", "casino", "long" * 20, "exe"]) for _ in range(rng.randint(0, 9))) for _ in range(500)] + ["*lit?", ""]
    hits = machine.match([u.encode() for u in urls])
    for u, row in zip(urls, hits):
        assert row.tolist() == [bool(pattern(g).fullmatch(u)) for g in rules], u


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q#f", "x://example.net", "x://example.net/", "http://b.org/fr/", "http://b.org/frx", "x://h#f", "x://example.com/de/../net/", "x://a\nb/c"]
    df = spark.createDataFrame([(None if k == 0 else k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in globs.judged(df, queries.SITE_RULES).collect()}
    assert got[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5] == ("example.net", "", None, "allow") and got[6][2:] == ("net/", "block") and got[7][2:] == ("org/fr/", "allow")
    assert got[10][2:] == ("example.com/de/", "block") and got[None][:2] == ("", "") and got[11][0] == "a\nb"
    assert globs.judged(df.limit(0), queries.SITE_RULES).isEmpty()


def test_lm_counts_by_brute_force(spark):
    rows = docs(spark).select("doc_id", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    words = {r["doc_id"]: [*re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().translate(ctw.LOWER)), b" end"] for r in rows}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in queries.op9_lm_scoring(spark, SF).collect()}
    for d, ws in words.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    size = sum(len((r["text"] or "").encode()) + 1 for r in rows if held[r["doc_id"]])
    assert -sum(r["score"] for d, r in got.items() if held[d]) * math.log2(10) / size < 4  # bits a byte


def test_lm_edges(spark, odd, empty):
    got = ctw.scores(odd, F.col("doc_id") > 3).collect()
    assert len(got) == odd.count() and all(r["score"] < 0 and math.isfinite(r["base_score"]) for r in got)
    assert ctw.scores(empty, F.lit(True)).isEmpty()


def test_bpe_equals_the_library(spark, odd, empty, tokenizer):
    for df in (odd, docs(spark)):
        got = {(r["id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in bpe.round_trip(df, queries.vocabulary()).collect()}
        want = set()
        for r in df.select("doc_id", "text").collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            back = tokenizer.decode(ids, skip_special_tokens=False)
            want.add((r["doc_id"], hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), len(ids)))
        assert got == want
    assert bpe.round_trip(empty, queries.vocabulary()).isEmpty()


def test_workers_give_memory_back():
    """Freed blocks below one that stays in use go back to the system."""
    held, kept = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10, []

    def run(batches):
        for batch in batches:
            many = [bytes(600) for _ in range(200_000)]
            kept.append(bytes(600))
            del many
            yield batch

    left = []
    for f in (run, arrays.thrifty(run)):
        assert list(f(iter([1, 2]))) == [1, 2]
        left.append(held())
    assert left[1] < left[0] - 60


def test_bpe_on_random_strings(tokenizer):
    coder = bpe.Bpe(open(queries.vocabulary(), encoding="utf-8").read())
    table = bpe.OffsetTable(open(queries.vocabulary(), encoding="utf-8").read())
    rng = random.Random(5)
    letters = list("abcdeth sinr.,'\n\t  ABé中\u3000\x85\u200b1290!?)😀") + ["<|endoftext|>", "'s", "'ll", "   ", "\r\n"]
    for _ in range(1500):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text
        assert table.decode(coder.encode(text)) == tokenizer.decode(ids, skip_special_tokens=False)
    assert pretoken.simple("a b\nc")


def test_pipeline_stage_by_stage(spark):
    d = docs(spark)
    one = corpus_pipeline.toxicity_stage(spark, d, SF)
    model = toxicity.fit(d, queries.table(spark, SF, "labels").filter(~queries.held_out(5, 0)))
    assert {r[0] for r in one.select("doc_id").collect()} == {r["doc_id"] for r in d.collect() if model.score(r["text"]) < 0.5}
    two = corpus_pipeline.simhash_stage(spark, d, SF)
    prints = {r["doc_id"]: brute_print(r["text"]) for r in d.collect()}
    groups, least = brute_groups(set(prints.values()), 2), {}
    for k, p in prints.items():
        least[groups[p]] = min(k, least.get(groups[p], k))
    assert sorted(r[0] for r in two.select("doc_id").collect()) == sorted(least.values())
    three = corpus_pipeline.mixing_stage(spark, d, SF)
    assert three.columns == d.columns and {r[0] for r in three.select("doc_id").distinct().collect()} == set(prints)
    assert corpus_pipeline.bpe_stage(spark, three, SF).count() == three.count()
    for stage in (corpus_pipeline.simhash_stage, corpus_pipeline.mixing_stage):
        assert stage(spark, d.limit(0), SF).columns == d.columns


def test_pipeline_mixes_to_the_token_and_encodes_every_row(spark, tokenizer):
    d = docs(spark)
    three = corpus_pipeline.mixing_stage(spark, d, SF).cache()
    rows = d.select(*mixing.leaf_columns(d, queries.domain(), "doc_id", "text"))
    leaves = rows.groupBy(*mixing.TREE).agg(F.sum("n_tokens").alias("tokens"))
    want = {tuple(r[c] for c in mixing.TREE): r["tokens"] + r["budget"] for r in mixing.allocate(leaves, corpus_pipeline.TARGETS).collect()}
    got = Counter()
    for r in three.select(*mixing.leaf_columns(three, queries.domain(), "doc_id", "text")).collect():
        got[r["domain"], r["lang"], r["source"]] += r["n_tokens"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    whole = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}
    copies = Counter()
    for r in three.collect():
        copies[r["doc_id"]] += 1
        assert r["text"] is None or whole[r["doc_id"]].startswith(r["text"]) and (r["text"] == whole[r["doc_id"]] or r["n_chars"] == len(r["text"]))
    assert set(copies) == set(whole) and max(copies.values()) <= corpus_pipeline.TARGETS.max_epochs + 1
    digests = Counter()
    for r in three.select("doc_id", "text").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        digests[r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.bpe_stage(spark, three, SF).collect())) == digests


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    labels = queries.table(spark, SF, "labels")
    for name, df in (("odd", odd), ("none", empty)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = {r["doc_id"] for r in out}
    assert {3, 4, 7, 9, 10, 0} <= kept and not kept & {1, 2, 5, 6}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_token_files_of_one_id(spark, tokenizer):
    df = spark.createDataFrame([(None, f"row {k} of many {k * 7}") for k in range(10_000)], "doc_id long, text string").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = tokenfile.write(df, queries.vocabulary()).cache()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.select("pid").distinct().count() > 3
    got = tokenfile.read(manifest).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    texts = sorted(f"row {k} of many {k * 7}" for k in range(10_000))
    for g, t in list(zip(got, texts))[::500]:
        assert bytes(g["ids"]) == np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_vocabularies_that_the_cutter_does_not_know_are_refused():
    spec = json.loads(open(queries.vocabulary(), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        with pytest.raises(ValueError):
            pretoken.specials(spec | change)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
