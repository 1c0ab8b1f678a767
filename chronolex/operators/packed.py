"""The cube of words and their neighbours in a packed form: what is shuffled are compressed blocks of partial sums.

Nearly every pair of a word and a neighbour is another one, so a row a pair makes a shuffle many times the size of the texts,
and the cutoff's join shuffles all of it once more. Here a task sums the pairs of about a million tokens, deals its words and
times out to buckets by a hash, and packs a bucket's sums into one block. A bucket's blocks meet in one place, which holds all
contexts of its words, so sums and cutoff need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.operators.cube import Cube
from chronolex.operators.ngrams import NOUNS


def neighbour_cube(tokens: DataFrame, cutoff: int = 0, size: int = 5, reach: int = 3, col: str = "tokens", chunk: int = 1_000_000, most: int = 4_000_000) -> Cube:
    """The cube (word, context, time, count) of neighbour_slots, of words whose counts in a bin sum to more than the cutoff.

    `tokens` has a time column. There are as many buckets as shuffle partitions, or 32 if those are fewer. Memory is bounded by the pairs of `chunk`
    tokens (or of one text) and by `most` sums: a bucket of more is summed in shares of its words, one after the other.
    A null time is a bin of its own.
    """
    buckets = max(32, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = tokens.schema["time"].dataType.simpleString()
    tags = [*NOUNS, "ADJ"]

    def pack(batches):
        from zlib import crc32

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        zstd = pa.Codec("zstd", compression_level=3)

        def among(x, n):
            """The values of x, which are below n, and each one's place among them."""
            seen = np.zeros(n, bool)
            seen[x] = True
            return np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]

        def block(words, word, when, runs, context, count):
            """Words with their times and numbers of contexts; then contexts and counts. Integers by bytes: first bytes first."""
            (own, word_at), (near, context_at) = among(word, len(words)), among(context, len(words))
            names = [words.take(pa.array(x)) for x in (own, near)]
            columns = [*(pc.binary_length(x).to_numpy() for x in names), word_at, when, runs, context_at, count]
            planes = []
            for x in columns:
                wide = max(1, (int(x.max()).bit_length() + 7) // 8)
                planes.append((len(x), wide, b"".join((x >> (8 * k)).astype(np.uint8).tobytes() for k in range(wide))))
            head = np.array([v for n, wide, _ in planes for v in (n, wide)], "<i8").tobytes()
            raw = head + b"".join(p for *_, p in planes) + b"".join(x.buffers()[2].to_pybytes()[: int(n.sum())] for x, n in zip(names, columns[:2], strict=True))
            return len(raw).to_bytes(8, "little") + zstd.compress(raw, asbytes=True)

        def sums(times, at, text, named, lengths):
            """Blocks of the sums over whole rows: `at` is a row's time, text and named are its tokens in one stretch."""
            if not named.any():
                return
            coded = text.dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()  # strings in order take less space in a block
            words, ids = coded.dictionary.take(pa.array(order)), np.argsort(order)[coded.indices.to_numpy()]
            length = np.repeat(lengths, lengths)
            place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            # words with their times, numbered in the order of their buckets
            groups, number = np.unique((np.repeat(at, lengths) * len(words) + ids)[named], return_inverse=True)
            hashes = np.fromiter((crc32(w.encode()) for w in words.to_pylist()), np.int64, len(words))
            salts = np.array([crc32(repr(t).encode()) for t in times], np.int64)
            bucket = (hashes[groups % len(words)] ^ salts[groups // len(words)]) % buckets
            order = np.argsort(bucket, kind="stable")
            groups, bucket, rank = groups[order], bucket[order], np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            group = np.zeros(len(ids), np.int64)
            group[named] = rank[number]
            bits, pairs = len(words).bit_length(), []
            group <<= bits + 4
            ids <<= 4
            for d in range(1, reach + 1):
                n = np.minimum(place[:-d], length[:-d] - size) - np.maximum(place[:-d] + d - (size - 1), 0) + 1
                ok = (place[:-d] + d < length[:-d]) & (n > 0)
                for x, y, z in ((group[:-d], ids[d:], named[:-d]), (group[d:], ids[:-d], named[d:])):
                    z = z & ok
                    pairs.append(x[z] | y[z] | n[z])
            pairs = np.concatenate(pairs)
            pairs.sort()
            code = pairs >> 4
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            count, code = np.add.reduceat(pairs & 15, first), code[first]
            del pairs, first
            context, code = code & ((1 << bits) - 1), code >> bits
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            groups, bucket, starts = groups[code[starts]], bucket[code[starts]], np.r_[starts, len(code)]
            word, when, runs = groups % len(words), groups // len(words), np.diff(starts)
            ends = np.flatnonzero(np.r_[np.diff(bucket) != 0, True]) + 1
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                own = slice(int(starts[lo]), int(starts[hi]))
                yield int(bucket[lo]), block(words, word[lo:hi], when[lo:hi], runs[lo:hi], context[own], count[own])

        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(col))
            lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            kept = np.flatnonzero(lengths >= size)
            dated = batch.column(batch.schema.get_field_index("time")).dictionary_encode(null_encoding="encode")
            times, at = dated.dictionary.to_pylist(), dated.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            upto, lo = np.cumsum(lengths[kept]), 0
            while lo < len(kept):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + chunk, "right")))
                k = kept[lo:hi]
                lemma, pos = rows.take(pa.array(k)).flatten().flatten()
                text = pc.binary_join_element_wise(lemma, pos, "_", null_handling="skip")
                named = pc.is_in(pos, value_set=pa.array(tags)).to_numpy(zero_copy_only=False)
                found = list(sums(times, at[k], text, named, lengths[k]))
                if found:
                    used = [[repr(t) for t in times]] * len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary()), pa.array(used, pa.list_(pa.string()))], ["bucket", "sums", "times"])
                lo = hi

    def unpack(batches):
        from ast import literal_eval

        import numpy as np
        import pyarrow as pa

        zstd = pa.Codec("zstd")
        types = {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}

        def opened(x):
            """A block's words and contexts as strings, and its sums: word, time, context, count."""
            raw = zstd.decompress(x[8:], int.from_bytes(bytes(x[:8]), "little"), asbytes=True)
            head, at, columns = np.frombuffer(raw, "<i8", 14), 112, []
            for n, wide in head.reshape(7, 2).tolist():
                x = np.zeros(n, np.int64)
                for k in range(wide):
                    x |= np.frombuffer(raw, np.uint8, n, at + k * n).astype(np.int64) << (8 * k)
                columns.append(x)
                at += n * wide
            names = []
            for size_of in columns[:2]:
                offsets = np.r_[0, np.cumsum(size_of)].astype(np.int32)
                names.append(pa.StringArray.from_buffers(len(size_of), pa.py_buffer(offsets), pa.py_buffer(raw[at : at + int(offsets[-1])])))
                at += int(offsets[-1])
            word, when, runs, context, count = columns[2:]
            return names, np.repeat(word, runs), np.repeat(when, runs), context, count

        def ids(arrays):
            """All strings once, and each array's places among them."""
            coded = pa.concat_arrays(arrays).dictionary_encode()
            return coded.dictionary, np.split(coded.indices.to_numpy().astype(np.int64), np.cumsum([len(x) for x in arrays])[:-1])

        def share(blocks, own, values, number, shares):
            """The sums of the words whose number, by `shares`, leaves this remainder; with names of contexts."""
            contexts, words, codes, near, counts = [], own[1], [], [], []
            for at, (x, times) in enumerate(blocks):
                names, word, when, context, count = opened(x)
                moved = np.array([values[t] for t in times], np.int64)
                key = words[at][word]
                ok = key % shares == number
                seen, context = np.zeros(len(names[1]), bool), context[ok]
                seen[context] = True
                used, context = np.flatnonzero(seen), (np.cumsum(seen) - 1)[context]
                contexts.append(names[1].take(pa.array(used)))
                codes.append(moved[when[ok]] * len(own[0]) + key[ok])
                near.append(context)
                counts.append(count[ok])
            if not sum(map(len, counts)):
                return
            names, moved = ids(contexts)
            context = np.concatenate([m[c] for m, c in zip(moved, near, strict=True)])
            code, count = np.concatenate(codes), np.concatenate(counts)
            del codes, near, counts
            code *= len(names)
            code += context
            del context
            wide = int(count.max()).bit_length()
            if int(code.max()).bit_length() + wide < 63:
                code = code << wide | count
                code.sort()
                count = code & ((1 << wide) - 1)
                code >>= wide
            else:
                order = np.argsort(code)
                code, count = code[order], count[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            code, count = code[first], np.add.reduceat(count, first)
            code, context = np.divmod(code, len(names))
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            mass, runs = np.add.reduceat(count, start), np.diff(np.r_[start, len(code)])
            kept = np.flatnonzero(np.repeat(mass > cutoff, runs)) if cutoff else np.arange(len(code))
            dates = pa.array([literal_eval(t) for t in values], types[kind])
            for lo in range(0, len(kept), 200_000):
                k = kept[lo : lo + 200_000]
                yield pa.RecordBatch.from_arrays([own[0].take(pa.array(code[k] % len(own[0]))), names.take(pa.array(context[k])), dates.take(pa.array(code[k] // len(own[0]))), pa.array(count[k], pa.int64())], ["word", "context", "time", "count"])

        for batch in batches:
            for r in range(batch.num_rows):
                packed, times = batch.column(0)[r].values.flatten()
                blocks = [(x.as_buffer(), y) for x, y in zip(packed, times.to_pylist(), strict=True)]  # not copied
                values = {t: k for k, t in enumerate(sorted({t for _, times in blocks for t in times}))}
                total, words = 0, []
                for x, _ in blocks:
                    names, word, *_ = opened(x)
                    total += len(word)
                    words.append(names[0])
                own, shares = ids(words), -(-total // most)
                for number in range(shares):
                    yield from share(blocks, own, values, number, shares)

    rows = tokens.select("time", col).mapInArrow(pack, "bucket int, sums binary, times array<string>")
    met = rows.groupBy("bucket").agg(F.collect_list(F.struct("sums", "times")).alias("blocks")).select("blocks")
    return Cube(met.mapInArrow(unpack, f"word string, context string, time {kind}, count long"), ("word",))
