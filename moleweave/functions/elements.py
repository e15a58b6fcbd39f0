"""Element numbers and default valences."""

#: The symbols of elements 1 to 118 in order.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {symbol: i + 1 for i, symbol in enumerate(SYMBOLS)} | {"*": 0}
#: The usual valences of uncharged elements, lowest first; other elements have no limit.
VALENCES = {
    "H": (1,), "B": (3,), "C": (4,), "N": (3,), "O": (2,), "F": (1,), "Si": (4,), "P": (3, 5, 7), "S": (2, 4, 6), "Cl": (1,), "Ge": (4,), "As": (3, 5, 7),
    "Se": (2, 4, 6), "Br": (1,), "Te": (2, 4, 6), "I": (1, 3, 5),
}
#: Elements that may be written without brackets, and so get hydrogens up to a usual valence.
PLAIN = ("B", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I")
