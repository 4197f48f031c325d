"""Word updates follow no path back where nothing settles, and keep little of sessions that have ended."""

import numpy as np
from test_live import run, spoken

from echolark.functions.warping import StreamLabels
from echolark.streaming import live


class Counted(list):
    seen = 0

    def __getitem__(self, k):
        Counted.seen += 1
        return super().__getitem__(k)


def test_frames_that_settle_nothing_are_not_followed_back():
    path = StreamLabels([1, 2, 3, 1])
    path.moves, even = Counted(), np.log(np.full(4, 0.25))
    assert all(path.push(even) == [] for _ in range(60)) and len(path.moves) == 60
    assert Counted.seen == 0


def test_a_restored_path_goes_on_as_one_that_never_stopped():
    rng = np.random.default_rng(8)
    for beam in (np.inf, 30.0, 3.0):
        labels = rng.integers(1, 4, 8).tolist()
        whole, parts, given = StreamLabels(labels, 0, beam), StreamLabels(labels, 0, beam), 0
        for row in np.log(rng.dirichlet(np.ones(4) / 3, 50)):
            found = whole.push(row)
            assert parts.push(row) == found and parts.kept() == whole.kept()
            parts, given = StreamLabels(labels, 0, beam, parts.scores, parts.kept()), given + len(found)
        assert whole.finish() == parts.finish() and (given or beam > 3)


def test_an_ended_session_keeps_no_path():
    words, session = [4, 0, 7, 7], live.WordUpdates()
    end = [(10**6, 999, None, True, words)]
    out, open_ = session.step(7, spoken(words)[:33], None)
    assert isinstance(open_[1], bytes) and isinstance(open_[2], bytes) and not open_[8]
    rest, ended = session.step(7, spoken(words)[33:] + end, open_)
    assert [r[2] for r in out + rest] == [0, 1, 2, 3] == [r.word for r in run(session, [spoken(words) + end])]
    assert ended == session.ENDED and not any(x for x in ended if x is not True)
    assert session.step(7, spoken(words), ended) == ([], session.ENDED)
