"""Vocabularies of the removal-target analysis; each can be replaced."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default word lists.
NOUNS = tuple(
    "man woman lady boy girl baby child kid person guy toddler infant mother father mom dad grandma grandmother grandpa "
    "grandfather cyclist driver player dancer singer skater teacher student referee goalkeeper cameraman spectator soldier "
    "chef waiter clown magician performer host dog cat horse bird monkey bear elephant rabbit fish hamster parrot puppy "
    "kitten chicken duck pig cow goat sheep lion tiger deer turtle lizard frog pug lioness penguin crab snake camel bus car "
    "truck bicycle bike motorcycle bulldozer tractor rider climber swimmer runner gymnast animal".split()
)
PLURALS = {
    "men": "man", "women": "woman", "ladies": "lady", "boys": "boy", "girls": "girl", "babies": "baby", "children": "child",
    "kids": "kid", "people": "person", "guys": "guy", "toddlers": "toddler", "dogs": "dog", "cats": "cat", "horses": "horse",
    "birds": "bird", "monkeys": "monkey", "players": "player", "dancers": "dancer", "skaters": "skater", "adults": "person",
    "puppies": "puppy", "kittens": "kitten", "animals": "animal", "pugs": "pug", "lionesses": "lioness", "penguins": "penguin",
    "riders": "rider", "buses": "bus", "cars": "car", "trucks": "truck", "bicycles": "bicycle", "bikes": "bike",
    "bulldozers": "bulldozer",
}
ADJECTIVES = tuple(
    "white black red blue green yellow brown pink grey gray orange purple dark light shirtless bald small big little tall "
    "short old young older younger blonde male female striped spotted thin fat long curly".split()
)
CLOTHING = tuple(
    "shirt dress vest jacket hat cap shorts pants skirt uniform stripes stripe top sweater hoodie coat suit tie scarf glasses "
    "sunglasses helmet apron jersey headband bandana mask gloves boots shoes socks tshirt".split()
)
PREPOSITIONS = ("in", "with", "wearing")
QUANTITIES = ("two", "three", "four", "both", "several", "many", "few", "some")
AUXILIARIES = ("did", "does", "do", "is", "are", "was", "were", "has", "have", "had")
GENERIC = ("person",)


@dataclass(frozen=True)
class Vocabulary:
    nouns: tuple[str, ...] = NOUNS
    plurals: dict[str, str] = field(default_factory=lambda: dict(PLURALS))
    adjectives: tuple[str, ...] = ADJECTIVES
    clothing: tuple[str, ...] = CLOTHING
    generic: tuple[str, ...] = GENERIC

    @property
    def entities(self) -> tuple[str, ...]:
        return (*self.nouns, *self.plurals)

    @property
    def descriptors(self) -> tuple[str, ...]:
        return (*self.adjectives, *self.clothing)
