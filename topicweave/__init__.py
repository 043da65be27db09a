"""Topic analytics on Spark: clean, count, factor and search short texts."""

from topicweave.engine import TopicEngine
from topicweave.model import TopicModel
from topicweave.session import build_session

__all__ = ["TopicEngine", "TopicModel", "build_session"]
