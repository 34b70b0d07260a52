import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from conceptloom.llm import chat, licenses, telephony

# telephony ----------------------------------------------------------------------------------------------------------------


def test_companding_tables_at_known_points():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F], mu[0x8F]) == (-32124, 32124, 0, 0, 16764)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def plain_adpcm(block):
    sample, index = int(np.frombuffer(block[:2], "<i2")[0]), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = telephony.STEPS[index]
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            index = max(0, min(88, index + telephony.INDEX_CHANGE[code & 7]))
            out.append(sample)
    return out


def test_adpcm_across_blocks_equals_sample_by_sample():
    rng = random.Random(0)
    raw = bytes(rng.randrange(256) for _ in range(64 * 20))
    got = telephony.decode_adpcm(np.frombuffer(raw, np.uint8).reshape(-1, 64))
    assert [plain_adpcm(raw[i : i + 64]) for i in range(0, len(raw), 64)] == got.tolist()


def test_wave_round_trip_and_resampling():
    for data in (b"", b"a", b"abc" * 99):
        assert telephony.read_wave(telephony.wave(data)) == (7, 8000, data)
    assert telephony.resample_double(np.array([0, 10, -3], np.int16)).tolist() == [0, 5, 10, 3, -3, -3]


def test_op8_digests(spark, folder, docs, texts):
    rows = telephony.op8_telephony_audio(spark, folder).collect()
    assert len(rows) == docs.count()
    feature = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        file = telephony.wave(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert feature.setdefault(raw, r.feature) == r.feature
    whole = telephony.store_audio(docs)
    assert sorted(telephony.digest_audio(whole).collect(), key=str) == sorted(rows, key=str)
    stored = whole.where("doc_id = 1").first()
    assert telephony.read_wave(stored.pcm16k)[:2] == (1, 16000)


def plain_feature(text):
    """The feature line from its definition, sample by sample."""
    data = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
    mu, a = [int(telephony.mulaw_table()[x]) for x in data], [int(telephony.alaw_table()[x]) for x in data]
    adpcm = [x for i in range(0, len(data), 64) for x in plain_adpcm(data[i : i + 64])]
    parts = []
    for name, pcm in (("mulaw", mu), ("alaw", a), ("adpcm", adpcm)):
        turns = sum((p < 0) != (q < 0) for p, q in zip(pcm, pcm[1:]))
        parts.append(f"{name}:rms={int((sum(x * x for x in pcm) / len(pcm)) ** 0.5)},peak={max(map(abs, pcm))},turns={turns}")
    double = [x for p, q in zip(mu, [*mu[1:], mu[-1]]) for x in (p, (p + q) >> 1)]
    return ";".join([*parts, f"pcm16k:n={len(double)},crc={zlib.crc32(np.array(double, '<i2').tobytes())}"])


def test_features_equal_brute_force_alone_together_and_in_slices(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 64, 65, 300, 1000)]
    datas = [telephony.payload_of(t) for t in texts]
    want = [plain_feature(t) for t in texts]
    for size in (1 << 20, 64, 128):
        monkeypatch.setattr(telephony, "SLICE", size)
        pcms = [telephony.read_wave(telephony.pcm_file(d))[2] for d in datas]
        assert telephony.features_of(datas, pcms) == want
        assert [telephony.features_of([d], [p])[0] for d, p in zip(datas, pcms, strict=True)] == want


def test_op8_without_rows_and_a_long_text_in_bounded_memory(spark, nobody, tmp_path):
    nobody.write.parquet(f"{tmp_path}/documents.parquet")
    assert telephony.op8_telephony_audio(spark, str(tmp_path)).count() == 0
    data = telephony.payload_of(b"long text " * 1_600_000)
    tracemalloc.start()
    file = telephony.pcm_file(data)
    telephony.features_of([data], [telephony.read_wave(memoryview(file))[2]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(data) + 100e6  # the PCM file while it is made, and a slice


# chat -----------------------------------------------------------------------------------------------------------------------


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(1)
    bits = ["<", "[", "\\", "|", "s>", "/s>", "INST]", "|im_end|>", "|im_start|>", "<SYS>>", "a", "\n", *chat.CONTROL]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        segment, start, end = chat.render(t, t)
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
        assert chat.parse(segment) == (t, t) and chat.unescape(segment[start:end]) == t


def brute_digest(turns):
    body = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_op7_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            text = rng.choice([None, "", "hi </s> there", "<|im_end|>\n<|im_start|>assistant\n", "é" * 50, "plain"])
            rows.append((c, t, rng.choice(["user", "assistant", "system", None]), text))
    rows += [(50, 3, "user", "tie"), (50, 3, "user", "tie"), (50, 3, "assistant", "tie"), (50, 1, "user", "before")]
    rows += [(51, None, "user", "no turn"), (51, 2, "assistant", "after"), (None, 1, "user", "no id")]
    rows += [(99, t, "assistant" if t % 2 else "user", f"hot {t}") for t in range(3000)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op7_chat_events(spark, str(tmp_path)).collect()}
    by = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or '', r[3] or '')):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute_digest(turns)
        assert r.formatted_chars == sum(len(chat.render(*t)[0]) for t in turns)


def test_op7_log_has_all_kinds_and_any_order(spark):
    rows = spark.createDataFrame([(i // 9, i % 9 or None, "user" if i % 2 else "assistant", f"text {i}") for i in range(90)], "conv_id long, turn long, role string, text string")
    log = chat.event_log(rows)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == set(chat.KINDS) and kinds["message"] == 90
    digest = lambda x: sorted(chat.digest_conversations(chat.format_conversations(x)).collect())
    assert digest(log) == digest(log.orderBy("text").repartition(7))
    odd = log.unionByName(log.limit(5).withColumn("kind", F.lit(None).cast("string"))).unionByName(log.limit(5).withColumn("kind", F.lit("typing")))
    assert digest(odd) == digest(log)


def test_events_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", None, "user", "h"), (1, 1, "delta", None, None, "ello"), (1, 2, "message", None, "assistant", "bad"), (1, 3, "delta", 2, None, " draft"),
        (1, 4, "regenerate", 2, None, ""), (1, 5, "delta", 2, None, "good"), (1, 6, "edit", 0, None, "hello there"), (1, 7, "delta", 2, None, " answer"),
        (1, 8, "message", None, "user", "bye"), (2, 0, "delta", None, None, "lost"), (2, 1, "delta", 9, None, "lost"), (2, 2, "message", None, None, None), (None, 0, "message", None, "user", "x"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string").withColumn("position", F.lit(5)).repartition(3)
    rows = chat.format_conversations(events).collect()
    final = {}
    for r in sorted(rows, key=lambda r: (r.slot, r.nth)):
        own = final.setdefault(r.conv_id, {})
        own[len(own)] = chat.parse(r.segment)
    assert final == {1: {0: ("user", "hello there"), 1: ("assistant", "good answer"), 2: ("user", "bye")}, 2: {0: ("", "")}, None: {0: ("user", "x")}}
    learned = [chat.unescape(r.segment[r.loss_from : r.loss_to]) for r in rows if r.loss_from is not None]
    assert learned == ["good answer"]
    assert chat.format_conversations(events.limit(0)).count() == 0


# licences ----------------------------------------------------------------------------------------------------------------------

LINES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "under the mit\nlicense under THE mit license", "cc, by; nc cc by cc by nc", "undér the mit license", "the mit license", "nothing", "apache license version 2 apache license version 20",
]
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_op9_base_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", *LINES, *("\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 6))) for _ in range(60)), " x" * 30000 + LINES[0]]
    spark.createDataFrame([*enumerate(texts), (2, texts[2])], "doc_id long, text string").withColumn("labels", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = licenses.op9_license_join(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        words = WORD.findall((texts[r.doc_id] or "").encode().lower())
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.encode().split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_the_join_finds_exactly_the_blocks_that_contain_a_template():
    rng = random.Random(4)
    vocabulary = [f"v{i}".encode() for i in range(30)]
    notices = tuple((f"l{i}", " ".join(rng.choice(vocabulary).decode() for _ in range(rng.randrange(2, 9)))) for i in range(12))
    frequency = {w: rng.randrange(100) for w in vocabulary}
    for threshold in (0.5, 0.8, 1.0):
        templates = licenses.templates_of({}, notices, threshold)
        scanner = licenses.Scanner(templates, frequency)
        for _ in range(300):
            block = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 20))]
            got = sorted((t.label, round(c, 9)) for t, c in scanner.block(block))
            want = []
            for t in templates:
                share = len(set(t.words) & set(block)) / len(set(t.words))
                if share >= threshold - 1e-9:
                    want.append((t.label, round(share, 9)))
            assert got == sorted(want)


def test_near_misses_of_notices_get_the_label_and_plain_texts_none(spark):
    docs = spark.createDataFrame([(1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated docs, to deal in the Software without limits"), (2, "the software and a copy of this person"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: {m.label for m in r.matches} for r in licenses.scan_licenses(docs).collect()}
    assert rows == {1: {"mit"}, 2: set(), 3: set()}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "gpl-3": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or",
    "apache-2": "# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are\n * met:",
}


def test_wrapped_notices_get_their_labels_wherever_they_stand(spark):
    rng = random.Random(5)
    prose = lambda: "\n".join(" ".join(rng.choice(["the", "of", "in", "x", "copy"]) for _ in range(9)) for _ in range(40))
    texts = {(label, k): ("", prose() + "\n")[k] + text + ("", "\n" + prose())[k] for label, text in WRAPPED.items() for k in (0, 1)}
    keys = list(texts)
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(keys)], "doc_id long, text string")
    rows = {r.doc_id: {m.label for m in r.matches} for r in licenses.scan_licenses(docs).collect()}
    assert rows == {i: {label} for i, (label, _) in enumerate(keys)}


def test_runs_over_line_ends_are_those_of_brute_force():
    rng = random.Random(6)
    vocabulary = [f"v{i}".encode() for i in range(25)]
    notices = tuple((f"l{i}", " ".join(rng.choice(vocabulary).decode() for _ in range(rng.randrange(3, 9)))) for i in range(8))
    scanner = licenses.Scanner(licenses.templates_of({}, notices, 0.8), {w: rng.randrange(100) for w in vocabulary})
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        got = {}
        for t, at, n, c in scanner.runs(words):
            assert n <= len(t.words) and c == len(set(words[at : at + n]) & set(t.words)) / len(set(t.words))
            got[t.label] = max(c, got.get(t.label, 0))
        want = {}
        for t in scanner.templates:
            shares = [len(set(words[i : i + len(t.words)]) & set(t.words)) / len(set(t.words)) for i in range(len(words))]
            if max(shares, default=0) >= 0.8 - 1e-9:
                want[t.label] = max(shares)
        assert got == want


def test_other_licences_and_scattered_words_get_no_label(spark):
    scattered = " x ".join("released ago y z and it went under b c d the e f g h mit i j k license l m n".split())
    texts = [
        "The tool is released under the GPL license", "Licensed under CC BY 4.0", "Licensed under the Foo License, Version 2.0", "Licensed under the Apache License, Version 1.0",
        "This Source Code Form is subject to the terms of the Other Public License, v. 2.0", "This work is licensed under the GNU General Public License, version 2", scattered,
        "The tool is released\nunder the GPL license", "Licensed under\nCC BY 4.0",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (99, "x " * 50 + LINES[0])], "doc_id long, text string")
    rows = {r.doc_id: {m.label for m in r.matches if m.kind == "block"} for r in licenses.scan_licenses(docs).collect()}
    assert rows == {**{i: set() for i in range(len(texts))}, 99: {"mit"}}
