"""Organisms to broad groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "Other / unclassified"

# Broad group to the genera that are counted in it.
GENERA = {
    "Bats": "Desmodus Diphylla Artibeus Tadarida Pteronotus Eptesicus Molossus Lasiurus Noctilio Bauerus",
    "Birds": "Haemorhous Zonotrichia Junco Gallus",
    "Mammals": "Homo Mus Rattus Canis Bos Sus Ovis Oryctolagus Macaca Equus Felis Capra Trichechus Peromyscus Mesocricetus",
    "Fish": "Oncorhynchus Danio Salmo Oreochromis Thunnus Gadus Cyprinus Acipenser",
    "Bacteria": "Escherichia Xylella Bacillus Pseudomonas Staphylococcus Salmonella Acinetobacter Akkermansia Edwardsiella Flavobacterium Lactococcus Mesomycoplasma Vibrio Neisseria Enhygromyxa Fusobacterium",
    "Fungi / yeast": "Saccharomyces Aspergillus Candida Pichia Komagataella Hypocrea Trichoderma Neurospora Coccidioides",
    "Plants": "Arabidopsis Oryza Zea Triticum Glycine Cannabis Cicer Cucurbita Digitaria Gossypium Helianthus Lupinus Nicotiana Pisum Solanum Vigna Hordeum Brassica Medicago Phaseolus Arachis Vicia Vitis Sorghum Populus Olea Juglans Trifolium Spirodela Avena Ananas",
    "Invertebrates": "Octopus Hypsibius Meloidogyne Caenorhabditis Drosophila Apis Daphnia Aedes Galleria Spodoptera",
    "Algae": "Ectocarpus Saccharina Thalassiosira",
    "Amphibians": "Xenopus",
    "Protozoa / parasites": "Toxoplasma Plasmodium Trypanosoma Leishmania Naegleria Spironucleus Tetrahymena Stentor",
}


def taxon_group(organism: Column, genera: dict[str, str] = GENERA) -> Column:
    """The group of the name's genus; never guessed for genera that aren't listed."""
    genus = F.split_part(F.trim(organism), F.lit(" "), F.lit(1))
    known = F.create_map(*(F.lit(x) for group, names in genera.items() for g in names.split() for x in (g, group)))
    return F.coalesce(F.try_element_at(known, genus), F.lit(OTHER))
