import numpy as np

from spanloom.llm import kernels


def test_long_data_is_hashed_in_parts():
    """Equal hashes wherever words stand, and no powers kept for the whole of the data."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 6 << 20).astype(np.uint8)
    data[rng.integers(0, len(data), 1 << 20)] = 0x20
    start, end, _ = kernels.words(data, np.array([0, len(data)]))
    kernels._POW[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    got = kernels.slice_hashes(data, start, end)
    assert len(kernels._POW[0]) < 2 << 20
    some = rng.integers(0, len(start), 3000)
    assert [int(got[i]) for i in some] == [int(kernels.slice_hashes(data[start[i] : end[i]], np.array([0]), np.array([end[i] - start[i]]))[0]) for i in some]
    assert (kernels.slice_hashes(data, start[::-1], end[::-1]) == got[::-1]).all()
