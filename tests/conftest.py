import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from itemlake.session import local_session  # noqa: E402

BLOCK_SCHEMA = ("doc_id string, block_idx long, type string, text string, text_level int, "
                "page_idx int, img_path string, html string")


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, memory="6g")


@pytest.fixture(scope="session")
def make_blocks(spark):
    """Blocks from ``(type, text)`` or ``(type, text, page, level)`` tuples per document."""
    def make(*documents, start=0):
        rows = []
        for d, blocks in enumerate(documents):
            for i, b in enumerate(blocks):
                kind, text, page, level = (*b, *(0, None)[len(b) - 2:]) if len(b) < 4 else b
                image = text if kind == "image" else None
                rows.append((f"d{d}", start + i, kind, "" if image else text, level, page, image, None))
        return spark.createDataFrame(rows, BLOCK_SCHEMA).repartition(3)
    return make
