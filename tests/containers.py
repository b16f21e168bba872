"""The writers of small synthetic containers, as the tests name them."""

from slidemill.sources.samples import *  # noqa: F403
