"""Operators that work text by text, against brute force on edge cases and a generated table."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from gneiss.llm import bpe, licences, media, packing

from .fixtures import SF, edge_docs, empty_docs


@pytest.fixture(scope="module")
def docs(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet")
    return edge_docs(spark).select("doc_id", "text", "word", "shard").unionByName(some.selectExpr("doc_id + 1000 as doc_id", "text", "'x' as word", "1 as shard")).cache()


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", " <|endoftext|>\n\n", "x<|endoftext|>don't"]
    docs = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(enumerate(special, 5000)), "doc_id long, text string"))
    got = {}
    for r in packing.pack(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    seqs = set()
    for doc, text in texts_of(docs):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(got[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0)
            assert r.length & (r.length - 1) == 0 and r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.sequence_id not in seqs
            seqs.add(r.sequence_id)
            at += r.length
        assert at == len(ids)
    assert packing.pack(empty_docs(spark)).count() == 0


def test_bpe(spark, docs):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode_decode(docs))
    for doc, text in texts_of(docs):
        ids = enc.encode_ordinary(text)
        r = got[doc]
        assert r.n_tokens == len(ids), doc
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(empty_docs(spark)).count() == 0
    full = by_id(bpe.encode_decode(edge_docs(spark), full=True))
    assert full[8].decoded.endswith("don't we'll") and full[8].ids == enc.encode_ordinary(full[8].decoded)


def test_licences(spark, docs):
    got = by_id(licences.scan(docs))
    all_texts = texts_of(docs)
    assert len(got) == len(all_texts)
    hits = 0
    for doc, text in all_texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = []
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        r = got[doc]
        assert (r.n_words, r.n_base) == (len(ws), len(places)), doc
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert r.first_word == min((i for i, _ in places), default=None)
        assert r.last_word == max((i for i, _ in places), default=None)
        assert 0 <= r.score <= 1
        hits += len(places)
    assert hits > 5
    assert got[6].labels == "mit,mit-notice"
    assert licences.scan(empty_docs(spark)).count() == 0


def test_repeated_ids_are_scanned_row_by_row(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (1, "nothing")], "doc_id long, text string")
    assert sorted(r.n_base for r in licences.scan(df).collect()) == [0, 1, 1]


def test_licence_spans_are_verified(spark):
    gpl = "This work is licensed under the GNU {}General Public License, version {}"
    cases = [
        ("under the sea under the sun under the moon", ""),
        ("the mit license the mit license under the under the", ""),
        ("mit license mit license mit license", ""),
        ("the mit license. the mit license", ""),
        (gpl.format("", "2"), ""),
        (gpl.format("Lesser ", "2.1"), ""),
        (gpl.format("Lesser ", "3"), ""),
        (gpl.format("Affero ", "3"), ""),
        ("Licensed under CC BY 4.0", ""),
        ("Licensed under CC BY-NC-SA 4.0", ""),
        ("Licensed under CC BY-NC 3.0", ""),
        ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ""),
        ("Licensed under the Apache License, Version 1.1", ""),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software", ""),
        (gpl.format("", "3"), "gpl-3.0"),
        ("word " * 50 + gpl.format("", "3") + " word" * 50, "gpl-3.0"),
        ("It is licensed under the terms of the GNU General Public License, version 3", "gpl-3.0"),
        ("Released under the terms of the MIT License", "mit-notice"),
        ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
        ("Licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit-grant"),
        (gpl.format("", "2") + ". " + gpl.format("", "3"), "gpl-3.0"),
    ]
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    got, phrases = by_id(licences.scan(df)), set(licences.PHRASES.values())
    for i, (text, label) in enumerate(cases):
        assert ",".join(sorted(set(got[i].labels.split(",")) - phrases)) == label, text
    assert (got[15].n_spans, got[15].first_span, got[15].last_span_end) == (1, 50, 61)
    assert (got[17].first_span, got[17].last_span_end, got[22].n_spans) == (0, 7, 1)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def longest_chain(ws, template):
    """The longest chain of k-gram hits by the rule of the module's docstring, over all pairs of hits."""
    k, t = licences.K, template.split()
    hits = [(i, j) for i in range(len(ws) - k + 1) for j in range(len(t) - k + 1) if ws[i : i + k] == t[j : j + k]]
    best = {}
    for i, j in sorted(hits):
        before = [n for (p, a), n in best.items() if p < i and a < j and j - a <= licences.LEAP and i - p <= licences.LEAP + licences.GAP and abs((i - j) - (p - a)) <= licences.GAP]
        best[i, j] = 1 + max(before, default=0)
    return max(best.values(), default=0)


def test_licence_labels_and_scores_by_brute_force(spark, docs):
    """Labels only where a chain of enough different template positions is there; score is the best span's share; exact notices and shuffled ones."""
    import random

    rng = random.Random(3)
    made = []
    for label, notice in licences.TEMPLATES.items():
        ws = notice.split()
        made += [(notice, {label}), (" ".join(ws * 3), {label}), (" ".join(rng.sample(ws, len(ws))), None), (" ".join(ws[: len(ws) // 3] * 4), set())]
        made.append((f"x y z {' '.join(ws[:3])} or so {' '.join(ws[3:])} and more", None))
    more = spark.createDataFrame([(9000 + i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionAll(more)
    got, seen = by_id(licences.scan(every)), 0
    for doc, text in texts_of(every):
        r, ws = got[doc], words_of(text)
        if doc is not None and doc < 9000 and not r.n_spans and len(ws) > 3000:
            continue
        share = {label: longest_chain(ws, x) / (len(x.split()) - licences.K + 1) for label, x in licences.TEMPLATES.items()}
        own = set(r.labels.split(",")) - {"", *licences.PHRASES.values()}
        assert own <= {label for label, x in share.items() if x >= licences.SHARE}, doc
        base = 1.0 if r.n_base else 0.0
        assert base <= r.score <= max([base, *(share[x] for x in own)]) + 1e-12 and (r.score > 0) == bool(own or r.n_base), doc
        assert not r.n_spans or 0 <= r.first_span < r.last_span_end <= r.n_words, doc
        seen += len(own)
    for i, (_, want) in enumerate(made):
        if want is not None:
            assert set(got[9000 + i].labels.split(",")) - {"", *licences.PHRASES.values()} == want, made[i]
    assert seen > 20


def test_licence_templates_of_ones_own(spark):
    df = spark.createDataFrame([(1, "under the Example Public Licence, sixth edition"), (2, "nothing of it")], "doc_id long, text string")
    got = by_id(licences.scan(df, {"example": "example public licence sixth edition"}))
    assert (got[1].labels, got[2].labels) == ("example", "")
    with pytest.raises(ValueError):
        licences.scan(df, {"long": "word " * (licences.MOST + 1)})


def test_media(spark, docs):
    got = by_id(media.audio(docs))
    for doc, text in texts_of(docs):
        raw = text.encode()
        n = max(1, -(-len(raw) // 192)) * 192
        payload = raw.ljust(n)
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), n)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = media.wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.samples(stored) == payload
    assert got[9].feature == got[10].feature and got[1].feature == got[2].feature
    assert media.audio(empty_docs(spark)).count() == 0


def test_media_frames_cover_every_sample(monkeypatch):
    """Log-mel frames against one transform of the whole signal, and features that see the last bytes of any text."""
    _, _, window, bank = media._filters()
    for block in (media.BLOCK, 192 * 3):
        monkeypatch.setattr(media, "BLOCK", block)
        for n in [*range(192, 192 * 14, 192), 577, 5001]:
            x = np.random.default_rng(n).integers(32, 127, n).astype(np.uint8)
            full = np.append(x, np.uint8(128)) if n % 2 else x
            y = media._halved((full.astype(np.float32) - 128) / 128)
            count = 1
            while (count - 1) * media.HOP + media.FRAME < len(y):
                count += 1
            y = np.pad(y, (0, (count - 1) * media.HOP + media.FRAME - len(y)))
            frames = np.array([y[i * media.HOP :][: media.FRAME] * window for i in range(count)])
            mel, energy = media.log_mel(x)
            assert mel.shape == (count, media.MELS) and len(energy) == count
            assert np.allclose(mel, np.log(abs(np.fft.rfft(frames)) ** 2 @ bank + 1e-6), atol=1e-3)
            for cut in (16, 64, 128):
                other = x.copy()
                other[-cut:] = 255 - other[-cut:]
                one, two = media.features(x)[0], media.features(other)[0]
                assert abs(one - two).max() > 0.01, (n, cut)
            assert all(0 <= a < b <= n / media.RATE for a, b in media.features(x)[1])
    level = np.tile(np.array([96, 160], np.uint8).repeat(8), 192)
    for n in (768, 1536, 1728):
        energy = media.log_mel(level[:n])[1]
        assert abs(energy - energy[1]).max() < 0.5


def test_media_blocks_agree(monkeypatch):
    x = np.random.default_rng(1).integers(0, 256, 50_000).astype(np.uint8)
    whole, e1 = media.log_mel(x)
    monkeypatch.setattr(media, "BLOCK", 192 * 7)
    parts, e2 = media.log_mel(x)
    assert whole.shape == parts.shape and np.allclose(whole, parts, atol=1e-3) and np.allclose(e1, e2, atol=1e-3)


def test_media_resampling_keeps_low_tones_and_drops_high_ones():
    t = np.arange(16_000) / 16_000
    low = media._halved(np.sin(2 * np.pi * 500 * t).astype(np.float32))[100:-100]
    high = media._halved(np.sin(2 * np.pi * 7000 * t).astype(np.float32))[100:-100]
    assert abs(low).max() > 0.95 and abs(high).max() < 0.02


def test_media_spans_and_tensor(spark):
    assert media.spans(np.array([0, 0.7, 1, 0.7, 0.65, 0.1, 0.7, 0])) == [(2, 5)]
    r = media.audio(edge_docs(spark).where("doc_id = 7"), full=True).collect()[0]
    assert len(r.tensor) == media.BINS * media.MELS and media.samples(bytes(r.media))[:5000] == b"x" * 5000
    rows = [r for r in media.audio(edge_docs(spark)).collect()]
    files = [media.read_tensor_file(bytes(f.file)) for f in media.stored(edge_docs(spark)).collect()]
    kept = {(i, tuple(t.ravel().tolist()), tuple((w["start"], w["end"]) for w in s)) for f in files for i, t, s in zip(f["doc_id"].to_pylist(), f["tensor"].combine_chunks().to_numpy_ndarray(), f["spans"].to_pylist())}
    assert kept == {(r.doc_id, tuple(r.tensor), tuple((w.start, w.end) for w in r.spans)) for r in rows} and len(rows) == sum(f.num_rows for f in files)
    assert all(f.schema.field("tensor").type.shape == [media.BINS, media.MELS] for f in files)


def test_media_features_by_brute_force(spark, docs):
    """Tensor, spans and feature of each text from a plain recomputation, frame by frame."""
    _, _, window, bank = media._filters()
    t = np.arange(media.TAPS) - (media.TAPS - 1) / 2
    lowpass = np.sinc(t / 2) / 2 * np.hamming(media.TAPS)
    lowpass /= lowpass.sum()
    got = by_id(media.audio(docs))
    for doc, text in texts_of(docs)[:60]:
        raw = text.encode()
        x = np.frombuffer(raw.ljust(max(1, -(-len(raw) // 192)) * 192), np.uint8)
        y = (np.append(x, np.full(len(x) % 2, 128)) - 128.0) / 128
        padded = np.concatenate([np.zeros(media.TAPS // 2), y, np.zeros(media.TAPS // 2)])
        y = np.convolve(padded, lowpass, "valid")[:-1][::2]
        mel, energy, a = [], [], 0
        while True:
            part = y[a : a + media.FRAME]
            f = np.zeros(media.FRAME)
            f[: len(part)] = part * window[: len(part)]
            mel.append(np.log(abs(np.fft.rfft(f)) ** 2 @ bank + 1e-6))
            whole = (window**2).sum() / (window[: len(part)] ** 2).sum() if a else 1
            energy.append(np.log((f**2).sum() * whole + 1e-6))
            if a + media.FRAME >= len(y):
                break
            a += media.HOP
        n = len(mel)
        bins = [(i * n // media.BINS, max((i + 1) * n // media.BINS, i * n // media.BINS + 1)) for i in range(media.BINS)]
        tensor = np.array([np.mean(mel[min(a, n - 1) : max(b, min(a, n - 1) + 1)], axis=0) for a, b in bins])
        low, high = min(energy), max(energy)
        on, spans = False, []
        for i, e in enumerate(energy):
            if on and e < low + media.LOW * (high - low):
                on = False
                spans[-1][1] = i
            elif not on and e >= low + media.HIGH * (high - low):
                on = True
                spans.append([i, n])
        step = 2 * media.HOP / media.RATE
        r = got[doc]
        assert np.allclose(np.array(r.tensor).reshape(tensor.shape), tensor, atol=1e-4), doc
        want = [(a * step, min((b - 1) * step + 2 * media.FRAME / media.RATE, len(x) / media.RATE)) for a, b in spans]
        assert np.allclose([(s.start, s.end) for s in r.spans], want) and len(r.spans) == len(want), doc
        assert r.feature.endswith(f":spans={len(spans)}:voiced={sum(s.end - s.start for s in r.spans):.3f}")


def test_bpe_long_words(monkeypatch):
    """Words that are cut, words that can't be, and ordinary texts sent the same way; slices and segments of any size."""
    import base64
    import random

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    eng, rng = bpe.Engine(path), random.Random(1)
    draw = lambda letters, k: "".join(rng.choices(letters, k=k))
    texts = [
        "x" * 30_000, " " * 9000 + "a", "-" * 7001, draw(["the", "ing", "straße", "é", "漢"], 900), "ab" * 500, draw("abcdefghijklmnopqrstuvwxyz", 20_000),
        draw("ab", 3000), draw(["=" * 70, "a" * 33, "b", "the", "on"], 300), "abcdefghij" * 400, draw("漢字仮名交じり文章", 2000), "\n" * 5000,
        draw(["in", "er", "at", "ion", "over", "al", "re"], 2000),
    ]
    for limit, segment, chunk in ((bpe.LONG, bpe.SEGMENT, bpe.CHUNK_CHARS), (40, 700, 900), (1, 5000, 10**6)):
        monkeypatch.setattr(bpe, "LONG", limit)
        monkeypatch.setattr(bpe, "SEGMENT", segment)
        monkeypatch.setattr(bpe, "CHUNK_CHARS", chunk)
        for text in [*(t if limit > 1 else t[:4000] for t in texts), "The quick, brown fox - don't! 12345 \n\n  ok"]:
            eng.cache.clear()
            n, ids_hash, raw_hash, ids, raw = eng.documents([text], full=True)[0]
            want = enc.encode_ordinary(text)
            assert (n, ids, raw) == (len(want), ",".join(map(str, want)), text.encode())
            assert (ids_hash, raw_hash) == (hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest())


def test_bpe_a_megabyte_of_random_letters():
    """No crash, and time in proportion."""
    import random
    import time

    import public_tokenizers

    eng, rng = bpe.Engine(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), random.Random(2)
    text, began = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), time.perf_counter()
    assert eng.documents([text])[0][2] == hashlib.sha256(text.encode()).hexdigest()
    assert time.perf_counter() - began < 180


def test_licence_bodies(spark):
    """Whole texts with changed words and breaks, parts of them, and prose with the same pairs of words."""
    mit, bsd, gpl = (licences.BODIES[x].split() for x in ("mit-text", "bsd-warranty", "gpl-text"))
    changed = [*mit[:30], "hereinafter", *mit[30:90], "a", "few", *mit[92:]]
    apache = licences.BODIES["apache-2.0-text"].replace("version 2 0 the", "Version 2.0 (the").replace("http www apache org licenses license 2 0", "http://www.apache.org/licenses/LICENSE-2.0")
    lesser = " ".join(gpl).replace("gnu general", "gnu lesser general")
    cases = [
        (" ".join(mit).upper(), "mit-grant,mit-text"),
        ("Copyright 2020 someone\n\n" + "\n * ".join(changed) + "\nthe end", "mit-grant,mit-text"),
        (" ".join(mit[:60]), "mit-grant"),
        (" ".join(mit[::2]), ""),
        ("word " * 300 + " ".join(bsd) + " word" * 300, "bsd-warranty"),
        (apache, "apache-2.0,apache-2.0-text"),
        (" ".join(gpl), "gpl-text"),
        (" ".join(gpl).replace("version 3", "version 2"), ""),
        (lesser, ""),
        ("in the end of the day in the hope that it will be useful for any purpose and to any person in the world", ""),
        ("\n".join(t.strip() for t in licences.BODIES.values()), ",".join(sorted([*licences.BODIES, "apache-2.0", "mit-grant"]))),
    ]
    got, phrases = by_id(licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"))), set(licences.PHRASES.values())
    for i, (text, labels) in enumerate(cases):
        assert ",".join(sorted(set(got[i].labels.split(",")) - phrases - {""})) == labels, (i, got[i].labels)
    assert (got[4].first_span, got[4].last_span_end) == (300, 300 + len(bsd) - 1)
    assert got[0].score == 1.0 and got[3].score == 0.0
