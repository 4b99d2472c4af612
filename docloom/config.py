"""Settings of the search engine."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Sections that are scored, in summation order, and their weights.
SECTIONS = ("title", "fabula", "vs_position", "full", "tags")
WEIGHTS = {"title": 3.0, "fabula": 0.7, "vs_position": 3.0, "full": 1.0, "tags": 5.0}

#: General stop words, then those of the domain.
STOP_WORDS = tuple(
    """
    и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от
    меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам
    ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего
    раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем
    чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через
    эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том
    нельзя такой им более всегда конечно всю между также
    суд вс рф дело определение постановление
    """.split()
)


@dataclass(frozen=True)
class SearchConfig:
    """as_of_year stands for the wall clock; min_token and token define words; top is the cap of each layer."""

    as_of_year: int = 2026
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    rrf_k: int = 60
    layer_weights: tuple[float, float] = (1.0, 1.0)
    top: int = 100
    token: str = "[а-яёa-z0-9]+"
    min_token: int = 2
    stop_words: tuple[str, ...] = STOP_WORDS
    freshness: float = 0.30
    freshness_years: float = 4.0
    structured: float = 1.10
    proximity: float = 0.5
    window: int = 3
    section_factor: float = 1.5
    snippet: int = 250
    reconcile_years: bool = False
