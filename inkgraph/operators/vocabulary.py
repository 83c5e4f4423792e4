"""Published word lists of the action operators, as they are; none is chosen or ordered here."""

from __future__ import annotations

# Keywords that are taken for entities where no model finds one.
KEYWORDS = (
    "MPTP", "rotenone", "paraquat", "trichloroethylene", "perchloroethylene", "dopamine", "iron", "calcium", "superoxide", "peroxide", "hydroxyl", "ROS", "glucocerebroside", "neuromelanin",
    "α-synuclein", "a-synuclein", "synuclein", "LRRK2", "Parkin", "PINK1", "DJ-1", "ATP13A2", "SNCA", "GBA", "glucocerebrosidase", "Nrf2", "Keap1",
    "mitochondria", "mitochondrion", "lysosome", "complex I", "electron transport chain", "microglia", "astrocyte", "astrocytes", "neuron", "neurons", "dopaminergic",
    "PD", "IPD", "parkinsonism", "Gaucher", "substantia nigra", "SN", "striatum", "CNS",
)

# Nouns that name an action, by their base.
NOMINALIZATIONS = {
    "mutation": ["mutation", "mutations"], "duplication": ["duplication", "duplications"], "deletion": ["deletion", "deletions"], "insertion": ["insertion", "insertions"], "substitution": ["substitution", "substitutions"],
    "expression": ["expression", "overexpression"], "regulation": ["regulation", "deregulation"], "activation": ["activation"], "inhibition": ["inhibition"], "suppression": ["suppression"],
    "misfolding": ["misfolding"], "aggregation": ["aggregation"], "accumulation": ["accumulation"], "formation": ["formation"], "degradation": ["degradation"],
    "degeneration": ["degeneration", "neurodegeneration"], "dysfunction": ["dysfunction"], "damage": ["damage"], "loss": ["loss"], "death": ["death"], "survival": ["survival"], "clearance": ["clearance"],
    "oxidation": ["oxidation"], "reduction": ["reduction"], "phosphorylation": ["phosphorylation"], "ubiquitination": ["ubiquitination"], "acetylation": ["acetylation"], "methylation": ["methylation"], "peroxidation": ["peroxidation"],
    "transmission": ["transmission"], "transport": ["transport"], "trafficking": ["trafficking"], "spread": ["spread", "spreading"], "propagation": ["propagation"], "translocation": ["translocation"],
    "exposure": ["exposure"], "treatment": ["treatment"], "administration": ["administration"], "onset": ["onset"], "progression": ["progression"], "development": ["development"], "deficiency": ["deficiency"],
    "inflammation": ["inflammation", "neuroinflammation"], "response": ["response"], "release": ["release"], "uptake": ["uptake"], "recycling": ["recycling"], "reuptake": ["reuptake"],
    "increase": ["increase"], "decrease": ["decrease"], "change": ["change", "changes"], "impairment": ["impairment"], "disruption": ["disruption"], "interference": ["interference"],
    "toxicity": ["toxicity", "neurotoxicity"], "susceptibility": ["susceptibility"], "vulnerability": ["vulnerability"], "binding": ["binding"], "interaction": ["interaction"],
    "production": ["production"], "synthesis": ["synthesis"], "catalysis": ["catalysis"], "reaction": ["reaction"],
}
