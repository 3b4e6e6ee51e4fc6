import random

import pytest

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo".split()


@pytest.fixture()
def words():
    """A maker of invented words."""
    rng = random.Random(11)
    return lambda n: " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 4))) for _ in range(n))
