"""Operators against brute force on small tables with the odd cases."""

import hashlib
import random
import zlib
from collections import Counter
from math import ceil, log10

import numpy as np
import pytest

from ambervec.llm import audio, chat, hmm, near_dedup, packing, quality, substrings, token_counts
from ambervec.llm.common import Words, pack, unpack
from ambervec.llm.tokens import PieceCounts

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, score double, pid int, key string, n_words long"


def corpus(seed=0, n=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "Über", "it's", "12,5", "日本", "the", "The"]
    passage = [rng.choice(vocab) for _ in range(30)]
    texts = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            words[5:5] = passage[i % 7 :]
        texts.append(rng.choice([" ", "\n", "  ", "\t"]).join(words))
    texts += [None, "", "  ", texts[0], texts[3], texts[3] + " w1", "x" * 3000 + " é" * 50, "one", "one two three"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "k", 7) for i, t in rows], SCHEMA).repartition(3)


def wordlist(t, lower=False):
    raw = (t or "").encode()
    return [w for w in (raw.lower() if lower else raw).split()]


def test_words_and_blobs():
    data = np.frombuffer(b" ab c\n\x0bd  e", np.uint8)
    w = Words(data, np.array([0, 0, 5, 11, len(data)]))
    assert [bytes(data[a:b]) for a, b in zip(w.start, w.end)] == [b"ab", b"c", b"d", b"e"][: len(w)]
    assert len(set(w.hashes().tolist())) == len(w)
    a, b = np.arange(5, dtype=np.uint64), np.array([5, 1, 9, -4, 2])
    x, y = unpack(pack(a, b), np.uint64, np.int64)
    assert (x == a).all() and (y == b).all()


def test_packing(spark):
    rows = corpus()
    for cap in (64, 4096):
        out = packing.best_fit_packing(frame(spark, rows), P.path("word_bpe_49k.json"), cap).collect()
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
        total, got = 0, {(r.doc_id, r.piece): r for r in out}
        for i, t in rows:
            ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            total += len(ids)
            for k in range(ceil(len(ids) / cap)):
                r, part = got.pop((i, k)), ids[k * cap : (k + 1) * cap]
                assert (r.start, r.length, r.ids_crc32) == (k * cap, len(part), zlib.crc32(part.tobytes()))
        assert not got
        seqs = {}
        for r in out:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= cap
        assert len(seqs) <= ceil(total / cap) * 1.15 + 1


def test_plan_is_close_to_the_bound():
    rng = random.Random(4)
    hist = Counter(min(4096, int(rng.lognormvariate(6.5, 1)) + 1) for _ in range(20000))
    plan = packing.plan_packing(hist, 4096)
    used = Counter()
    for length, lo, hi, _, _, _ in plan.tolist():
        used[length] += hi - lo
    assert used == hist
    seqs = max(s + ceil((hi - lo) / m) for _, lo, hi, s, m, _ in plan.tolist())
    assert seqs <= 1.005 * sum(k * v for k, v in hist.items()) / 4096 + 1
    assert packing.plan_packing({}, 64).shape == (0, 6)


def test_token_counts(spark):
    import sentencepiece

    rows = corpus()
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, rows), P.path("piece_bpe_32k.model"), 60, 64, 8).collect()}
    for i, t in rows:
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 60)


def test_overlaps_are_widened():
    c = PieceCounts(P.path("piece_bpe_32k.model"), 32, 4)
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a", "ing", " ", "\n", "▁", "é", "日", "<s>", "xx"]) for _ in range(300))
        assert c.count([t, t.replace(" ", "").replace("\n", "")]) == [len(c.sp.encode(t)), len(c.sp.encode(t.replace(" ", "").replace("\n", "")))]


def test_chat(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(12), None]:
        for k in range(rng.randint(1, 30)):
            text = rng.choice([None, "", "</s>[INST] ok [/INST]", "a\\b <|turn:user|> <\\| \\\\ |> <|end|>\n", "é <s> " * 20, "w " * 600])
            rows.append((c, k, "system" if k == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "odd|<\\role"]), text, 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int").repartition(5)
    windows = chat.chat_windows(df, P.path("piece_bpe_32k.model"), 300, 120)
    for back in (chat.read_back(windows, True), chat.read_back(windows)):
        got = {r.conv_id: r for r in back.collect()}
        for c in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
            loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
            want = hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
            assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars) == (len(own), want, len(loss))
            assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    counter, seen = PieceCounts(P.path("piece_bpe_32k.model")), windows.collect()
    for r in seen:
        turns = chat.parse(r.text)
        cost = [counter.count([f"<|turn:{chat._escape_role(role)}|>{chat.escape(body)}<|end|>\n"])[0] for role, body, _, _ in turns]
        first = next(iter(sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])))
        kept = int(r.window > 0 and first[2] == "system")
        assert r.n_tokens == sum(cost) and len(turns) == r.n_repeated + r.n_turns and r.over_budget == (r.n_tokens > 300)
        assert not kept or turns[0][:2] == ("system", first[3] or "")
        assert sum(cost[kept : r.n_repeated]) <= 120 and r.n_repeated - kept <= 2
        # over the budget only where the system turn and one turn alone are
        assert r.n_tokens <= 300 or (r.n_turns == 1 and r.n_repeated == kept)
    assert any(r.n_repeated > 1 for r in seen) and any(r.over_budget for r in seen)
    assert chat.read_back(chat.chat_windows(df.limit(0), P.path("piece_bpe_32k.model"))).count() == 0


def test_chat_history_goes_before_the_budget_breaks():
    def windows(costs, first="system"):
        conv = chat._Conversation(1, 2048, 512, 2)
        out = [w for k, n in enumerate(costs) for w in conv.add((first if k == 0 else "user", str(k), n))]
        return [([m[1] for m in chat.parse(w[5])], w[3], w[7], w[8]) for w in [*out, conv.close()]]

    # 900 of system and 500 of history leave no room for 1000: the history goes
    assert windows([900, 600, 500, 1000, 10]) == [(["0", "1", "2"], 3, 2000, False), (["0", "3", "4"], 2, 1910, False)]
    # a large system turn stays, and only it and one turn pass the budget
    assert windows([1500, 300, 1000, 200, 100]) == [(["0", "1"], 2, 1800, False), (["0", "2"], 1, 2500, True), (["0", "3", "4"], 2, 1800, False)]
    assert windows([100, 200, 1700, 300, 40], "user") == [(["0", "1", "2"], 3, 2000, False), (["3", "4"], 2, 340, False)]
    assert windows([1000, 200, 300, 600, 40], "user") == [(["0", "1", "2"], 3, 1500, False), (["1", "2", "3", "4"], 2, 1140, False)]


def test_substrings(spark):
    rows = corpus()
    rows += [(100 + k, t) for k, (_, t) in enumerate(corpus(3, 10))]
    got = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, rows), part_bytes=400).collect()}
    assert len(got) == len(rows)
    seen = {}
    for i, t in rows:
        w = wordlist(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            seen[key] = min(seen.get(key, i), i)
    total = 0
    for i, t in rows:
        w = wordlist(t)
        gone = {j for k in range(len(w) - 12) if seen[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text.encode()) == (len(w), len(gone), kept)
        total += len(gone)
    assert total > 100
    assert substrings.difference_cover(7) == [0, 1, 3]
    assert substrings.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_hmm_counts_and_forward(spark):
    rows = corpus(5, 60)
    got = {r.doc_id: r for r in hmm.hmm_scores(frame(spark, rows), part_bytes=500).collect()}
    assert len(got) == len(rows)
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(x for i, t in rows if i not in out for x in [*wordlist(t, True), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*wordlist(t, True), None]
        base = sum(log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score <= 0
    assert hmm.hmm_scores(frame(spark, rows).limit(0)).count() == 0


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    k = hmm.STATES
    return hmm.Hmm.of(rng.random(k), rng.random((k, k)), rng.random((hmm.SYMBOLS + 1, k)))


def likelihood(m, sym):
    x = m.begin * m.emit[sym[0]]
    for s in sym[1:]:
        x = (x @ m.move) * m.emit[s]
    return x.sum()


@pytest.mark.parametrize("tokens", [1, 5, 1 << 19])
def test_forward_is_exact(monkeypatch, tokens):
    monkeypatch.setattr(hmm, "STEP_TOKENS", tokens)
    rng, m = np.random.default_rng(0), random_model()
    sym, first = rng.integers(0, 50, 19), np.array([0, 4, 4, 9, 10, 19])
    scale = m.forward(sym, first)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert abs(np.log(scale[a:b]).sum() - np.log(likelihood(m, sym[a:b]))) < 1e-9
    begin, moves, emit = m.counts(sym, first)
    assert abs(begin.sum() - 4) < 1e-9 and abs(moves.sum() - 15) < 1e-9 and abs(emit.sum() - 19) < 1e-9
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.move.sum(1), 1)
    # expected counts are derivatives of the log likelihood: one of each kind by difference
    for name, place, got in (("begin", 2, begin[2]), ("move", (1, 3), moves[1, 3]), ("emit", (sym[5], 4), emit[sym[5], 4])):
        logs = []
        for f in (1 - 1e-5, 1 + 1e-5):
            x = {n: getattr(m, n).copy() for n in ("begin", "move", "emit")}
            x[name][place] *= f
            logs.append(sum(np.log(likelihood(hmm.Hmm(**x), sym[a:b])) for a, b in zip(first[:-1], first[1:]) if b > a))
        assert abs((logs[1] - logs[0]) / 2e-5 - got) < 1e-5


def test_hmm_scores_by_brute_force(spark):
    rows, m = corpus(5, 30), random_model(3)
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(x for i, t in rows if i not in out for x in wordlist(t, True))

    def symbol(word):
        data = np.frombuffer(word, np.uint8)
        return int(hmm.symbols(Words(data, np.array([0, len(data)])).hashes())[0])

    room = Counter()
    for x, c in counts.items():
        room[symbol(x)] += c + 1
    got = {r.doc_id: r for r in hmm.scores_by(frame(spark, rows), m, sum(counts.values()), 5, part_bytes=300).collect()}
    for i, t in rows:
        words = wordlist(t, True)
        sym = [*map(symbol, words), hmm.SYMBOLS]
        want = log10(likelihood(m, sym)) + sum(log10((counts[x] + 1) / (room[s] + 1)) for x, s in zip(words, sym)) if len(words) < 60 else None
        assert want is None or abs(got[i].score - want) < 1e-6 * abs(want), (i, t)


def test_training_raises_the_likelihood(spark):
    """More rounds over all texts give a higher likelihood of them, beginning and all."""
    docs = frame(spark, corpus(5, 60))
    learned = []
    for rounds in (1, 3, 6):
        m, _, _ = hmm.train(docs, rounds=rounds)
        texts = [t for i, t in corpus(5, 60) if zlib.crc32(str(i).encode()) % 7 != 2]
        total = 0
        for t in texts:
            data = np.frombuffer(b" ".join(wordlist(t, True)), np.uint8)
            w = Words(data, np.array([0, len(data)]))
            total += np.log(m.forward(*hmm._with_end(hmm.symbols(w.hashes()), w.first))).sum()
        learned.append(total)
    assert learned[0] < learned[1] < learned[2]


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows, base = corpus(7, 20), [f"t{rng.randint(0, 400)}" for _ in range(150)]
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9999)}"
        rows.append((1000 + k, " ".join(w).upper() if k % 5 == 0 else "\n".join(w)))
    rows.append((None, " ".join(base)))
    got = {}
    for r in near_dedup.near_duplicates(frame(spark, rows), 4).collect():
        got[r.doc_id] = r
    sets = {}
    for i, t in rows:
        w = wordlist(t, True)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i, _ in rows if i is not None]
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i), i
    assert got[None].kept
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_repeated_ids_of_other_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (8, a + " more"), (None, a), (9, ""), (9, None)]
    out = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    assert out == [(-1, -1, True), (1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (7, 5, False), (8, 1, False), (9, 9, True), (9, 9, True)]
    left = sorted((r.doc_id or -1, r.text or "") for r in near_dedup.one_of_each(frame(spark, rows)).collect())
    assert left == sorted([(1, a), (5, b), (-1, a), (9, ""), (9, "")])


def test_quality_learns(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(["the", "of", "house", "green", "water", "time"]) for _ in range(rng.randint(5, 200))]
        good = i % 3 > 0
        rows.append((i, " ".join(words) if good else " ".join(w + "###" for w in words)))
        labels.append((i, int(good), 0))
    rows += [(999, None), (998, "")]
    docs, labs = frame(spark, rows), spark.createDataFrame(labels[:160], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labs, 150)
    out = {r.doc_id: r for r in quality.quality_scores(docs, model).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    held = [(out[i].score >= 0.7) == bool(q) for i, q, _ in labels[160:]]
    assert sum(held) / len(held) > 0.95
    assert quality.fit_quality(docs, labs.limit(0)) is None
    assert quality.quality_scores(docs, None).where("score = 1").count() == len(rows)
    assert set(quality.chunks_of(np.arange(200, dtype=np.uint8)).ravel()) >= set(range(200))


def test_audio(spark):
    rows = corpus()
    media = audio.store(frame(spark, rows))
    got = {r.doc_id: r for r in audio.audio_features(media).collect()}
    for i, t in rows:
        raw = audio.padded((t or "").encode())
        assert bytes(got[i].payload) == raw and len(raw) % 64 == 0 and raw
        mel, start, end = audio.read_tensors(got[i].tensors)
        assert mel.shape == (got[i].n_tensors, 64, 16) and mel.dtype == np.float32 and start[0] == 0
        assert (end[:-1] == start[1:]).all() and abs(end[-1] - -(-len(raw) // 2) / 8000) < 1e-9
    assert bytes(got[rows[0][0]].tensors) == bytes(got[next(i for i, t in rows[41:] if t == rows[0][1])].tensors)
    x = np.sin(np.arange(4000) / 20).astype(np.float32)
    y = audio.resample(x, 16000, 8000)
    assert abs(y[100:1900] - np.sin(np.arange(100, 1900) / 10)).max() < 0.1
    assert audio.segments(np.array([0, 0, 9, 4, 2, 0, 9], np.float32)) == [(2, 5), (6, 7)]
    import pyarrow as pa

    kind = pa.ipc.open_stream(got[rows[0][0]].tensors).schema.field("log_mel").type
    assert kind == pa.fixed_shape_tensor(pa.float32(), [64, 16])
    assert audio.audio_features(media.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    row = audio.audio_features(odd).first()
    assert row.tensors is None and row.payload_bytes is None and audio.digests(audio.audio_features(odd), ["doc_id"]).first().feature is None


def test_audio_by_brute_force(spark, tmp_path):
    """Every column of the query from the definitions, a frame and a band at a time."""
    rows = [(1, "hello world " * 150), (2, None), (3, ""), (4, "é日本" * 90), (5, "".join(chr(33 + k * k % 90) for k in range(30000)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in audio.query(spark, str(tmp_path)).collect()}
    features = {r.doc_id: r for r in audio.audio_features(audio.store(spark.read.parquet(f"{tmp_path}/documents.parquet"))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        wav = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0]) + (16000).to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0]) + b"data" + len(payload).to_bytes(4, "little") + payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        # resampling by direct convolution: every second sample of the low-passed signal
        x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
        h = np.sinc((np.arange(8) - 3.5) / 2) * np.hamming(8) / 2
        h = h / h.sum()
        pad = np.concatenate([np.full(4, x[0]), x, np.full(8, x[-1])])
        y = np.array([pad[2 * k : 2 * k + 8] @ h[::-1] for k in range(-(-len(x) // 2))])
        n = max(1, -(-max(len(y) - 256, 0) // 128) + 1)
        y = np.pad(y, (0, (n - 1) * 128 + 256 - len(y)))
        hz = np.arange(129) * 4000 / 128
        edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), 18) / 2595) - 1)
        want = np.full((-(-n // 64) * 64, 16), np.log(1e-6))
        for f in range(n):
            power = abs(np.fft.rfft(y[f * 128 : f * 128 + 256] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)))) ** 2
            for m in range(16):
                up, down = (hz - edge[m]) / (edge[m + 1] - edge[m]), (edge[m + 2] - hz) / (edge[m + 2] - edge[m + 1])
                want[f, m] = np.log(np.maximum(0, np.minimum(up, down)) @ power + 1e-6)
        mel, _, _ = audio.read_tensors(features[i].tensors)
        assert np.abs(mel.reshape(-1, 16) - want).max() < 0.02
        n_segments, _, n_tensors, digest = r.feature.split(";")
        assert int(n_segments) == len(features[i].segments) and int(n_tensors) == len(mel)
        assert digest == hashlib.sha256(np.round(mel * 100).astype("<i4").tobytes()).hexdigest()


def test_audio_digest_takes_all_frames(spark, tmp_path):
    """Texts that differ behind the fourth frame only have different features."""
    rows = [(i, "abcdefgh" * 300 + tail) for i, tail in enumerate(["q" * 200, "qz" * 100, "q" * 200])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    media = audio.audio_features(audio.store(spark.read.parquet(f"{tmp_path}/documents.parquet"))).collect()
    first = {r.doc_id: audio.read_tensors(r.tensors)[0][0] for r in media}
    assert (first[0][:4] == first[1][:4]).all() and not np.allclose(first[0], first[1], atol=0.05)
    mel = {r.doc_id: r.feature.split(";")[-1] for r in audio.query(spark, str(tmp_path)).collect()}
    assert mel[0] == mel[2] != mel[1]
