"""Line dedup against all pairs of lines by brute force, on the documents of sf0.01."""

import os
from collections import Counter, defaultdict

import pytest

from driftlens.llm import line_dedup

SF = "/root/testdata/sf0.01/documents.parquet"


def _shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_links_of_whole_table(spark):
    docs = spark.read.parquet(SF)
    lines = line_dedup.line_rows(docs.select("doc_id", "text"), "text").select("doc_id", "line_no", line_dedup.normal_line(line_dedup.F.col("line")).alias("line"))
    text = {(r.doc_id, r.line_no): r.line for r in lines.collect()}
    got = {(r.doc_id, r.line_no): r for r in line_dedup.dedup_lines(docs).collect()}
    assert set(got) == set(text)
    of = defaultdict(set)
    for k, r in got.items():
        of[text[k]].add(r.class_row)
    assert all(len(c) == 1 for line, c in of.items() if line)
    distinct = sorted(x for x in of if x)
    sets, index = [_shingles(x) for x in distinct], defaultdict(list)
    true, found, linked = 0, 0, defaultdict(set)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in index[x]).items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                true += 1
                found += of[distinct[i]] == of[distinct[j]]
                linked[i].add(j)
                linked[j].add(i)
        for x in s:
            index[x].append(i)
    assert true > 100 and found / true >= 0.98
    # No class joins lines that true links don't join.
    for c, members in Counter(next(iter(of[x])) for x in distinct).items():
        if members > 1:
            mine = {i for i, x in enumerate(distinct) if c in of[x]}
            seen, front = set(), [min(mine)]
            while front:
                i = front.pop()
                if i not in seen:
                    seen.add(i)
                    front += linked[i] & mine
            assert seen == mine
    sizes = Counter(r.class_row for r in got.values())
    assert all(r.class_size == sizes[r.class_row] for r in got.values())
    assert all(sum(1 for k in got if got[k].class_row == c and got[k].kept) == 1 for c in list(sizes)[:50])
