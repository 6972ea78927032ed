from monthmark.llm import common


def test_a_worker_keeps_the_cache_of_one_operator():
    a, b = {1: 2}, {3: 4}
    common.sole_keeper("a", a.clear)
    common.sole_keeper("a", a.clear)
    assert a == {1: 2}
    common.sole_keeper("b", b.clear)
    assert a == {} and b == {3: 4}
    common.sole_keeper("a", a.clear)
    assert b == {}
